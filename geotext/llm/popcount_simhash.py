"""Near copies by SimHash: fingerprints meet in a grid of bit counts and are then compared bit by bit.

A fingerprint is embedded as the bit counts of its 32 segments of two bits. A differing bit moves one
count by one at most, so the Manhattan distance of two embeddings never exceeds the number of
differing bits. Fingerprints that differ in four bits are within two in one of the
embedding's halves, and so have a grid point of that half within one of both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType

from geotext.llm.common import cut, placed, query, table
from geotext.operators.components import connected_components

SHINGLE_WORDS = 4
#: The grid is laid for this number of differing bits.
DIFFERING_BITS = 4
HASH_SEED = 42

#: Fingerprints at one grid point that a task compares; those at fuller points meet otherwise.
POINT_ROWS = 20_000
#: Runs up to this length are compared pair by pair at once.
SHORT_RUN = 8

#: Shingles hashed at once.
STRETCH = 1 << 16

_ODD = np.uint64(0x55555555)
_BANDS = 2
_SEGMENTS = 16


def shingle_hashes(text: str | None) -> Iterator[np.ndarray]:
    """XXH64 of each shingle, repeats included; a shorter text is one shingle, one without words none."""
    words = text.encode().lower().split() if text else []  # of bytes: ASCII letters and white space only
    if not words:
        return
    data = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = min(SHINGLE_WORDS, len(words))
    starts, ends = starts[: len(words) - n + 1], ends[n - 1 :]
    digest = xxhash.xxh64_intdigest
    for at in range(0, starts.size, STRETCH):
        some = zip(starts[at : at + STRETCH].tolist(), ends[at : at + STRETCH].tolist(), strict=True)
        yield np.array([digest(data[s:e], HASH_SEED) for s, e in some], dtype="<u8")


def fingerprint(text: str | None) -> int:
    """Bits that more than half of the hashes have, as a signed number."""
    ones, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        n += hashes.size
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


@F.pandas_udf(LongType())
def fingerprint_of(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


def grid_points(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(point, index)``: every grid point within one of a fingerprint's embedding, in either half.

    A point is the half's number and sixteen counts of two bits each, 0 to 2.
    """
    points, index = [], []
    each = np.arange(prints.size)
    unsigned = prints.view(np.uint64)
    for band in range(_BANDS):
        half = unsigned >> np.uint64(32 * band) & np.uint64(0xFFFFFFFF)
        centre = (half - (half >> np.uint64(1) & _ODD)).astype(np.int64)
        base = centre + (band << 32)
        points.append(base)
        index.append(each)
        for segment in range(_SEGMENTS):
            count, unit = centre >> (2 * segment) & 3, 1 << (2 * segment)
            for some, step in ((count < 2, unit), (count > 0, -unit)):
                points.append(base[some] + step)
                index.append(each[some])
    return np.concatenate(points), np.concatenate(index)


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64))


def link_points(point: np.ndarray, prints: np.ndarray, limit: int) -> np.ndarray:
    """Pairs (two columns) that join what is linked within each point; rows come sorted by point.

    Short runs give every link. In longer ones a search takes each fingerprint out as it is reached,
    so n fingerprints give fewer than n pairs, whose chains are those of all links.
    """
    begins = np.flatnonzero(np.concatenate([[True], point[1:] != point[:-1]])) if point.size else np.zeros(0, int)
    lengths = np.diff(np.append(begins, point.size))
    found = []
    short = np.repeat(lengths <= SHORT_RUN, lengths)
    for apart in range(1, SHORT_RUN):
        a, b = prints[:-apart], prints[apart:]
        same = (point[:-apart] == point[apart:]) & short[apart:]
        a, b = a[same], b[same]
        close = differing(a, b) <= limit
        found.append(np.c_[a[close], b[close]])
    for begin, length in zip(begins[lengths > SHORT_RUN], lengths[lengths > SHORT_RUN], strict=True):
        found.append(_search(prints[begin : begin + length], limit))
    pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
    return np.unique(np.sort(pairs, axis=1), axis=0)


def _search(prints: np.ndarray, limit: int) -> np.ndarray:
    left, pairs = prints, []
    while left.size > 1:
        reached, left = [left[0]], left[1:]
        while reached and left.size:
            at = reached.pop()
            close = differing(left, np.full(1, at)) <= limit
            if close.any():
                new, left = left[close], left[~close]
                pairs.append(np.c_[np.full(new.size, at), new])
                reached.extend(new)
    return np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64)


def links_of(prints: DataFrame, limit: int = DIFFERING_BITS, point_rows: int = POINT_ROWS) -> DataFrame:
    """``a, b``: pairs of distinct fingerprints (column ``fp``) that chain as all links do.

    Rows move to some fifty grid points each. No point gathers more than
    ``point_rows`` fingerprints in a task: those at a fuller one meet at every number within
    two bits of them instead, where only the lowest is noted, which is exact and linear.
    """
    if limit > DIFFERING_BITS:
        raise ValueError(f"the grid is laid for up to {DIFFERING_BITS} differing bits")

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fp = pdf["fp"].to_numpy()
            for start in range(0, fp.size, 2000):
                point, index = grid_points(some := fp[start : start + 2000])
                yield pd.DataFrame({"point": point, "fp": some[index]})

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        point = fp = np.zeros(0, np.int64)
        for pdf in batches:
            point = np.concatenate([point, pdf["point"].to_numpy()])
            fp = np.concatenate([fp, pdf["fp"].to_numpy()])
            done = int(np.searchsorted(point, point[-1])) if point.size else 0
            yield _pairs(link_points(point[:done], fp[:done], limit))
            point, fp = point[done:], fp[done:]
        yield _pairs(link_points(point, fp, limit))

    spots = prints.select("fp").mapInPandas(spread, "point long, fp long")
    full = cut(spots.groupBy("point").count().where(F.col("count") > point_rows).select("point"))
    if full.isEmpty():
        crowd, rest = None, spots
    else:
        crowd = cut(spots.join(full, "point", "left_semi").select("fp").distinct())
        rest = spots.join(full, "point", "left_anti")
    dealt = rest.repartition("point").sortWithinPartitions("point")
    links = dealt.mapInPandas(link, "a long, b long")
    return links if crowd is None else links.unionByName(_meet(crowd, limit))


def _pairs(pairs: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame(pairs, columns=["a", "b"])


def _meet(crowd: DataFrame, limit: int) -> DataFrame:
    """Two differ in at most ``limit`` bits if and only if they meet within half of that on each side."""
    near, far = limit // 2, limit - limit // 2
    flips = [np.uint64(0)] + [np.uint64(1 << i) for i in range(64)]
    flips += [np.uint64(1 << i | 1 << j) for i in range(64) for j in range(i)]
    ball = np.array(flips, np.uint64)
    size = np.bitwise_count(ball)

    def visit(radius: int):
        steps = ball[size <= radius].view(np.int64)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                fp = pdf["fp"].to_numpy()
                for start in range(0, fp.size, 100):
                    some = fp[start : start + 100]
                    yield pd.DataFrame({"at": (some[:, None] ^ steps).ravel(), "fp": np.repeat(some, steps.size)})

        return run

    here = crowd.mapInPandas(visit(near), "at long, fp long")
    if near == far:
        lowest = here.groupBy("at").agg(F.min("fp").alias("a"))
        return here.join(lowest, "at").where("a <> fp").select("a", F.col("fp").alias("b")).distinct()
    there = crowd.mapInPandas(visit(far), "at long, fp long").withColumnRenamed("fp", "b")
    # An odd limit: each names the lowest that comes nearer to the meeting point.
    lowest = here.groupBy("at").agg(F.min("fp").alias("a"))
    return there.join(lowest, "at").where("a <> b").select("a", "b").distinct()


def near_copies(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    limit: int = DIFFERING_BITS,
    point_rows: int = POINT_ROWS,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fingerprint, component_id, kept, row_tag``.

    Fingerprints at ``limit`` or fewer differing bits are linked; a component is all that can
    be reached, its id the smallest document id in it, its ``kept`` row the first with that
    id. A null id comes after all others, so a component has a null id only if all its rows
    have. Texts without words have the fingerprint 0, which links like any other. Other columns are not
    read. ``row_tag`` is the row's number by ``placed``.
    """
    tagged = placed(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    return _near(tagged, limit, point_rows)


def _near(tagged: DataFrame, limit: int = DIFFERING_BITS, point_rows: int = POINT_ROWS) -> DataFrame:
    """``near_copies`` for ``tagged (doc_id, text, row_tag)``."""
    made = cut(tagged.select("doc_id", "row_tag", fingerprint_of("text").alias("fp")))
    id_last = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_tag")
    prints = cut(made.groupBy("fp").agg(F.min(id_last).alias("first")))
    roots = connected_components(links_of(prints, limit, point_rows), [])
    rooted = prints.join(roots.withColumnRenamed("v", "fp"), "fp", "left")
    rooted = cut(rooted.withColumn("root", F.coalesce("root", "fp")))
    firsts = rooted.groupBy("root").agg(F.min("first").alias("component"))
    # Sort-merge joins, which Spark splits where one fingerprint or component has many rows.
    named = rooted.select("fp", "root").join(firsts.hint("merge"), "root").select("fp", "component")
    return made.join(named.hint("merge"), "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component.doc_id").alias("component_id"),
        (F.col("row_tag") == F.col("component.row_tag")).alias("kept"),
        "row_tag",
    )


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` for each component, with all its columns."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    tagged = placed(docs.toDF(*names))
    ids, texts = (F.col(names[docs.columns.index(k)]) for k in (doc_id, text))
    found = _near(tagged.select(ids.alias("doc_id"), texts.alias("text"), "row_tag")).where("NOT kept").select("row_tag")
    return tagged.join(found, "row_tag", "left_anti").select(names).toDF(*docs.columns)


@query("op1_popcount_simhash")
def op1_popcount_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return near_copies(docs).select("doc_id", "fingerprint", "component_id")
