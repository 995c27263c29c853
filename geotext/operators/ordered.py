"""Running totals and positions over an explicit order, without a one-task window.

The rows are range-partitioned on (group, order) into blocks. A running total is the
total inside the block plus what earlier blocks hold of the same group. Only a group
that spans blocks needs the second part, and each block has at most two such groups,
so that table has at most two rows per block.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from geotext.operators.skew import attach
from geotext.session import cut


def running_totals(
    df: DataFrame,
    totals: Mapping[str, Column],
    order: Sequence[str],
    group: Sequence[str] = (),
    blocks: int | None = None,
) -> DataFrame:
    """Add inclusive running sums of integer expressions, per group and in the given order.

    ``order`` must be unique within a group. A hot group is spread over as many blocks as
    its rows need.
    """
    group, order = list(group), list(order)
    spark = df.sparkSession
    blocks = blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    values = {name: f"_value_{i}" for i, name in enumerate(totals)}
    placed = (
        df.withColumns({values[name]: expr.cast("long") for name, expr in totals.items()})
        .repartitionByRange(blocks, *group, *order)
        .withColumn("_block", F.spark_partition_id())
    )
    placed = cut(placed)  # block numbers must be read back, never computed twice

    per_block = placed.groupBy("_block", *group).agg(
        *[F.sum(v).alias(v) for v in values.values()]
    )
    by_group = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = by_group.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    if group:
        # Keep only groups in more than one block: at most two per block.
        spans = per_block.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
        per_block = attach(per_block, spans.drop("_n"), group, rows=blocks, null_safe=True)
    earlier = per_block.select(
        "_block", *group, *[F.sum(v).over(before).alias(v + "_before") for v in values.values()]
    )
    here = (
        Window.partitionBy("_block", *group)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    inside = placed.withColumns({name: F.sum(v).over(here) for name, v in values.items()})
    joined = attach(inside, F.broadcast(earlier), ["_block", *group], "left", rows=0, null_safe=True)
    return joined.withColumns(
        {n: F.col(n) + F.coalesce(F.col(v + "_before"), F.lit(0)) for n, v in values.items()}
    ).drop("_block", *values.values(), *[v + "_before" for v in values.values()])


def with_position(
    df: DataFrame,
    order: Sequence[str],
    group: Sequence[str] = (),
    name: str = "position",
    blocks: int | None = None,
) -> DataFrame:
    """Number rows from 1 in the given order, per group if one is given."""
    return running_totals(df, {name: F.lit(1)}, order, group, blocks)


def split_at(df: DataFrame, n: int, order: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """Mark the first ``n`` rows of each group with ``part`` 0 and the rest with 1."""
    return with_position(df, order, group, "_position").select(
        *df.columns, F.when(F.col("_position") <= n, 0).otherwise(1).alias("part")
    )


def split_where(
    df: DataFrame, is_delimiter: Column, order: Sequence[str], group: Sequence[str] = ()
) -> DataFrame:
    """Cut each ordered group at its delimiter rows: the kept rows with their ``segment`` number.

    Delimiters are dropped. A segment with no rows keeps its number, so a gap below the
    last number of a group is an empty segment; ``segment_sizes`` lists them.
    """
    cut_rows = F.coalesce(is_delimiter, F.lit(False))
    numbered = running_totals(
        df.withColumn("_cut", cut_rows), {"segment": F.col("_cut").cast("long")}, order, group
    )
    return numbered.where(~F.col("_cut")).drop("_cut")


def split_on(
    df: DataFrame, column: str, delimiter, order: Sequence[str], group: Sequence[str] = ()
) -> DataFrame:
    """``split_where`` with equality to one value."""
    return split_where(df, F.col(column) == F.lit(delimiter), order, group)


def segment_sizes(segments: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Rows per segment, leading and inner empty ones included, trailing ones not."""
    group = list(group)
    sizes = segments.groupBy(*group, "segment").agg(F.count(F.lit(1)).alias("n"))
    # An empty segment lies just below a non-empty one: number the gap, not the whole range.
    filled = _with_previous(sizes, group)
    gaps = filled.select(
        *group,
        F.explode(
            F.when(
                F.col("segment") - 1 > F.col("_previous"),
                F.sequence(F.col("_previous") + 1, F.col("segment") - 1),
            )
        ).alias("segment"),
        F.lit(0).cast("long").alias("n"),
    )
    return sizes.unionByName(gaps)


def _with_previous(sizes: DataFrame, group: list[str]) -> DataFrame:
    """The last non-empty segment before each one, by position so that no group is one task."""
    placed = cut(with_position(sizes, ["segment"], group, "_position"))
    ahead = placed.select(
        *group, (F.col("_position") + 1).alias("_position"), F.col("segment").alias("_previous")
    )
    joined = attach(placed, ahead, [*group, "_position"], "left", rows=1, null_safe=True)
    return joined.withColumn("_previous", F.coalesce("_previous", F.lit(-1).cast("long")))


def drop_right_while(
    df: DataFrame, matches: Column, order: str, group: Sequence[str] = ()
) -> DataFrame:
    """Drop each group's longest trailing run of rows that match."""
    group = list(group)
    kept = F.when(~F.coalesce(matches, F.lit(False)), F.col(order))
    last = df.groupBy(*group).agg(F.max(kept).alias("_last"), F.count(F.lit(1)).alias("_rows"))
    if not group:
        # One row, read as a scalar: no join at all.
        return df.where(F.col(order) <= last.select("_last").scalar())
    kept_rows = attach(df, last, group, null_safe=True, count="_rows")
    return kept_rows.where(F.col(order) <= F.col("_last")).drop("_last", "_rows")


def drop_right_while_text(text: Column | str, characters: str) -> Column:
    """A text without its longest trailing run of these characters; NULL stays NULL."""
    inside = "".join("\\" + c if c in "\\]^-[&~" else c for c in characters)
    return F.regexp_replace(text, f"[{inside}]+\\z", "") if characters else F.col(text) if isinstance(text, str) else text


def zip_safe(
    left: DataFrame,
    right: DataFrame,
    left_order: Sequence[str],
    right_order: Sequence[str],
    group: Sequence[str] = (),
) -> DataFrame:
    """Pair two tables by position; the job fails if a row has no partner.

    Columns other than the group must differ between the two tables. Positions are
    unique within a group, so the join has no hot key.
    """
    keys = [*group, "position"]
    a = with_position(left, left_order, group)
    b = with_position(right, right_order, group)
    a = a.withColumn("_left", F.lit(True))
    b = b.withColumn("_right", F.lit(True))
    both = a.join(b, keys, "full_outer")
    unmatched = F.col("_left").isNull() | F.col("_right").isNull()
    checked = F.when(
        unmatched, F.raise_error(F.lit("zip_safe: the two sides differ in length")).cast("long")
    ).otherwise(F.col("position"))
    return both.withColumn("position", checked).drop("_left", "_right")


def zip_arrays(left: Column, right: Column) -> Column:
    """``arrays_zip`` that fails when the lengths differ."""
    return F.when(F.size(left) == F.size(right), F.arrays_zip(left, right)).otherwise(
        F.raise_error(F.lit("zip_safe: the two arrays differ in length"))
    )


def collect_chunks(
    df: DataFrame,
    keys: Sequence[str],
    value: Column,
    order: Sequence[str],
    chunk_rows: int = 10_000,
) -> DataFrame:
    """Collect each key's values in order, in arrays of at most ``chunk_rows``.

    ``(keys, chunk, items)`` with chunks counted from 0: read in chunk order they are the
    key's whole list. No array, and no task's group, grows with the key's row count.
    """
    keys = list(keys)
    numbered = with_position(df, order, keys, "_position")
    chunked = numbered.withColumn("chunk", F.floor((F.col("_position") - 1) / chunk_rows))
    entry = F.struct(F.col("_position").alias("p"), value.alias("v"))
    return (
        chunked.groupBy(*keys, "chunk")
        .agg(F.array_sort(F.collect_list(entry)).alias("_entries"))
        .select(*keys, "chunk", F.transform("_entries", lambda e: e["v"]).alias("items"))
    )
