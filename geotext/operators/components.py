"""Connected components by contraction, in a number of rounds logarithmic in their size."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from geotext.operators.skew import attach
from geotext.session import cut


def connected_components(
    edges: DataFrame, keys: list[str], rows: int | None = None
) -> DataFrame:
    """``(keys, v, root)`` for every vertex of ``edges (keys, a, b)``; the root is the lowest vertex.

    Each round points every vertex at its lowest neighbour if that is lower, follows the
    pointers to their ends by doubling, and replaces vertices by those ends. Components
    merge in groups of two or more per round. ``rows`` bounds the vertices
    under one key, and so the edges at a vertex, if known.
    """
    edges = cut(edges.select(*keys, "a", "b").where("a <> b").distinct())
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy(*keys, F.col("a").alias("v")).agg(F.min("b").alias("low"))
        ends = _follow(cut(lowest.select(*keys, "v", F.least("v", "low").alias("root"))), keys, rows)
        if labels is None:
            labels = ends
        else:
            labels = cut(_replace(labels, ends, keys, "root", rows))
        edges = _replace(_replace(edges, ends, keys, "a", rows), ends, keys, "b", rows)
        edges = cut(edges.where("a <> b").distinct())
    if labels is None:
        return edges.select(*keys, F.col("a").alias("v"), F.col("b").alias("root"))
    return labels


def _replace(
    df: DataFrame, ends: DataFrame, keys: list[str], column: str, rows: int | None
) -> DataFrame:
    """Put the end of its pointer in place of a vertex; vertices no longer in the graph stay."""
    pointers = ends.select(*keys, F.col("v").alias(column), F.col("root").alias("_end"))
    return (
        attach(df, pointers, [*keys, column], "left", rows)
        .withColumn(column, F.coalesce("_end", column))
        .drop("_end")
        .select(df.columns)
    )


def _follow(pointers: DataFrame, keys: list[str], rows: int | None) -> DataFrame:
    """Pointer doubling: every vertex points at the end of its chain."""
    while True:
        jumped = cut(
            attach(
                pointers,
                pointers.select(*keys, F.col("v").alias("root"), F.col("root").alias("_next")),
                [*keys, "root"],
                rows=rows,
            )
        )
        moving = not jumped.where(F.col("_next") != F.col("root")).isEmpty()
        pointers = jumped.select(*keys, "v", F.col("_next").alias("root"))
        if not moving:
            return pointers
