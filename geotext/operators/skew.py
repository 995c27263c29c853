"""Joins that hold when one key carries a large share of the rows."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from geotext.session import cut

#: Rows of one key that one task takes, whatever the table holds.
HOT_ROWS = 1_000_000

#: A list of hot keys up to this long is broadcast; a longer one is joined by shuffle.
BROADCAST_KEYS = 10_000


def hot_keys(
    df: DataFrame, keys: Sequence[str], rows: int | None = None, hot_rows: int | None = None
) -> DataFrame | None:
    """``(keys, hot_rows)`` of keys with more than ``hot_rows`` rows, stored, or None if there are none.

    There are at most as many of them as ``hot_rows`` goes into the table.
    ``rows`` is an upper bound on the rows of any key, if the caller knows one.
    """
    hot_rows = hot_rows or HOT_ROWS
    if rows is not None and rows <= hot_rows:
        return None
    # Counted before the shuffle, so the hot key itself costs one row per task.
    return _if_any(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("hot_rows")), hot_rows)


def _if_any(sizes: DataFrame, hot_rows: int) -> DataFrame | None:
    hot = cut(sizes.where(F.col("hot_rows") > hot_rows))
    return None if hot.isEmpty() else hot


def few_or_shuffled(keys: DataFrame) -> DataFrame:
    """A stored list of keys, to be broadcast if it is short."""
    short = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return F.broadcast(keys) if short else keys


def attach(
    big: DataFrame,
    per_key: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    rows: int | None = None,
    hot_rows: int | None = None,
    null_safe: bool = False,
    count: str | None = None,
) -> DataFrame:
    """Join ``big`` to a table with boundedly many rows per key, most often one.

    The rows of a key over ``hot_rows`` are dealt to as many parts as they need by a hash of the whole
    row, and the key's rows of ``per_key`` are copied to each part, so that no task takes more of
    one key however large the table is. (Rows alike in all columns stay together.) Tell
    what is known of the keys' sizes: a bound in ``rows``, or in ``count`` the
    column of ``per_key`` that holds each key's rows in ``big``; else ``big`` is
    counted first. With ``null_safe``, NULL is a key too.
    """
    hot_rows = hot_rows or HOT_ROWS
    if count is not None:
        per_key = cut(per_key)
        hot = _if_any(per_key.select(*keys, F.col(count).alias("hot_rows")), hot_rows)
    else:
        hot = hot_keys(big, keys, rows, hot_rows)
    if hot is None:
        return _join(big, per_key, keys, how, null_safe)
    tag = f"_{uuid.uuid4().hex[:8]}"
    parts = F.ceil(F.col("hot_rows") / hot_rows).cast("int").alias(tag)
    listed = few_or_shuffled(hot.select(*keys, parts))
    n = F.coalesce(F.col(tag), F.lit(1))
    deal = F.when(n > 1, F.pmod(F.xxhash64(*big.columns), n)).otherwise(0).cast("int")
    # By hand: a table that is already dealt by the key alone would pass as it is.
    left = _join(big, listed, keys, "left", True).withColumn(tag, deal).repartition(*keys, tag)
    copies = F.explode(F.sequence(F.lit(0), n - 1))
    right = _join(per_key, listed, keys, "left", True).withColumn(tag, copies)
    return _join(left, right, [*keys, tag], how, null_safe).drop(tag)


def _join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str, null_safe: bool
) -> DataFrame:
    if not null_safe:
        return left.join(right, list(keys), how)
    tag = f"_{uuid.uuid4().hex[:8]}_"
    renamed = right.withColumnsRenamed({k: tag + k for k in keys})
    condition: Column = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(renamed[tag + k])
    return left.join(renamed, condition, how).drop(*[tag + k for k in keys])
