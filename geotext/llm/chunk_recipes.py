"""Exact duplicates by recipes: texts as ordered lists of verified content-defined chunks."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from geotext.llm.common import cut, placed, query, short_batches, table

#: A boundary follows where this many low bits of the rolling value are zero: 2 KB on average.
BOUNDARY_BITS = 11
SMALLEST, LARGEST = 256, 16_384
#: Bytes that the rolling value looks back on.
LOOKBACK = 32

#: Names a chunk by a signed 64-bit number.
Name = Callable[[bytes], int]

_WHITE = b" \t\n\x0b\x0c\r"
_GEAR = np.random.default_rng(11).integers(0, 2**32, 256, dtype=np.uint32)


def normalise(data: bytes) -> bytes:
    """Each run of ASCII white space becomes one space, at the ends too."""
    if not data:
        return data
    body = b" ".join(data.split())
    if not body:
        return b" "
    return (b" " if data[0] in _WHITE else b"") + body + (b" " if data[-1] in _WHITE else b"")


def boundaries(data: bytes) -> list[int]:
    """Ends of the chunks, which depend on the bytes near them and the chunk's start alone."""
    if len(data) <= SMALLEST:
        return [len(data)] if data else []
    rolling = _GEAR[np.frombuffer(data, np.uint8)]
    step = 1
    while step < LOOKBACK:
        shifted = rolling[:-step] << np.uint32(step)
        rolling[step:] += shifted
        step *= 2
    # The upper bits have seen all of the lookback, the lower ones only the last bytes.
    ends = np.flatnonzero(rolling >> np.uint32(32 - BOUNDARY_BITS) == 0) + 1
    out, start = [], 0
    for end in [*ends.tolist(), len(data)]:
        if end - start < SMALLEST and end < len(data):
            continue
        while end - start > LARGEST:
            start += LARGEST
            out.append(start)
        if end > start:
            out.append(end)
            start = end
    return out


def chunk_hash(chunk: bytes) -> int:
    """A signed 64-bit name; names that two contents share are told apart later."""
    h = xxhash.xxh3_64_intdigest(chunk)
    return h - (1 << 64) if h >> 63 else h


def chunks_of(data: bytes) -> list[bytes]:
    start, out = 0, []
    for end in boundaries(data):
        out.append(data[start:end])
        start = end
    return out


def recipe_of(name: Name) -> Callable[[str], Column]:
    """A function of the text: its chunk names in order and the digest of the normalised text."""

    @F.pandas_udf("struct<recipe: array<long>, text_sha256: string>")
    def make(texts: pd.Series) -> pd.DataFrame:
        normal = [normalise(t.encode()) if t else b"" for t in texts]
        return pd.DataFrame(
            {
                "recipe": [[name(c) for c in chunks_of(n)] for n in normal],
                "text_sha256": [hashlib.sha256(n).hexdigest() for n in normal],
            }
        )

    return make


def chunk_rows(docs: DataFrame, tag: str, text: str = "text", name: Name = chunk_hash) -> DataFrame:
    """``(tag, seq, h, chunk)`` of every chunk, names and bytes."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [
                (t, i, name(c), c)
                for t, whole in zip(pdf[tag], pdf[text], strict=True)
                if whole
                for i, c in enumerate(chunks_of(normalise(whole.encode())))
            ]
            yield pd.DataFrame(rows, columns=["tag", "seq", "h", "chunk"])

    return docs.select(tag, text).mapInPandas(make, "tag long, seq int, h long, chunk binary")


def find_copies(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", name: Name = chunk_hash
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256, row_tag``.

    Texts are equal when their recipes are: the same verified chunks in the same order. Of
    equal texts the row with the smallest id stays; among rows that share the id, the
    first in the table. A null id comes after all others. Null and empty texts
    have the empty recipe and are equal. Other columns are not read.

    ``row_tag`` is the row's number by ``placed``, the
    same in each scan. Text moves once, as chunks, after equal ones of a task have been joined.
    Names are verified there: two contents under one name are given different numbers.
    """
    return _copies(placed(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))), name)


def _copies(tagged: DataFrame, name: Name = chunk_hash) -> DataFrame:
    """``find_copies`` for ``tagged (doc_id, text, row_tag)``."""
    lists = tagged.withColumn("_made", recipe_of(name)("text")).select("doc_id", "row_tag", "_made.*")
    with short_batches(tagged.sparkSession):
        lists = cut(lists.withColumn("apart", F.lit(None).cast("array<struct<seq:int,n:int>>")))
        contents = chunk_rows(tagged, "row_tag", name=name).select("h", "chunk").distinct()
        shared = cut(contents.groupBy("h").count().where("count > 1").select("h"))
        if not shared.isEmpty():
            lists = cut(_tell_apart(tagged, lists, shared, name))
    id_last = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_tag")
    groups = lists.groupBy("recipe", "apart").agg(
        F.min(id_last).alias("first"), F.count(F.lit(1)).alias("group_size")
    )
    # A sort-merge join, so that a recipe with a large share of the rows is split by Spark.
    l, g = lists.alias("l"), groups.alias("g").hint("merge")
    same = F.col("l.recipe").eqNullSafe(F.col("g.recipe")) & F.col("l.apart").eqNullSafe(F.col("g.apart"))
    return l.join(g, same).select(
        "l.doc_id",
        F.col("g.first.doc_id").alias("keep_id"),
        "g.group_size",
        (F.col("l.row_tag") == F.col("g.first.row_tag")).alias("kept"),
        "l.text_sha256",
        "l.row_tag",
    )


def _tell_apart(tagged: DataFrame, lists: DataFrame, shared: DataFrame, name: Name) -> DataFrame:
    """Number the contents behind each shared name, and note the numbers beside the recipes."""
    rows = cut(chunk_rows(tagged, "row_tag", name=name).join(shared, "h", "left_semi"))
    # Spread by content: each gets as its number the place among the few contents of its name.
    names = rows.select("h", "chunk").distinct()
    numbers = names.groupBy("h").agg(F.array_sort(F.collect_list("chunk")).alias("all"))
    numbers = numbers.select("h", F.posexplode("all").alias("n", "chunk")).where("n > 0")
    apart = (
        rows.join(numbers, ["h", "chunk"])
        .groupBy(F.col("tag").alias("row_tag"))
        .agg(F.array_sort(F.collect_list(F.struct("seq", "n"))).alias("apart"))
    )
    return lists.drop("apart").join(apart, "row_tag", "left").select(lists.columns)


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    tagged = placed(docs.toDF(*names))
    ids, texts = (F.col(names[docs.columns.index(k)]) for k in (doc_id, text))
    found = _copies(tagged.select(ids.alias("doc_id"), texts.alias("text"), "row_tag")).where("NOT kept").select("row_tag")
    return tagged.join(found, "row_tag", "left_anti").select(names).toDF(*docs.columns)


SQL = r"""
WITH texts AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = min(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM texts WINDOW same AS (PARTITION BY t)
"""


@query("op6_chunk_recipes", SQL)
def op6_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return find_copies(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
