"""Benchmark passages in documents: Wu-Manber search for many windows of words at once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import chain

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F

from geotext.llm.common import placed, query, stored, table

WINDOW = 10
#: Words of benchmark text searched for at once: about 150 MB in a worker's memory.
BLOCK_WORDS = 300_000

#: ASCII letters go to lower case, other ASCII that is no digit to a space; other bytes stay.
_FOLD = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20
    for b in range(256)
)

Words = list[bytes]


def words_of(text: str | None) -> Words:
    return text.encode().translate(_FOLD).split() if text else []


@dataclass
class Patterns:
    """Windows of one length, their shift table and their buckets.

    ``shift`` has, for each block of words in a window, how far the search may move when
    it meets the block; other blocks move it past themselves. A block that ends a
    window is not in it but in ``buckets``, whose windows are then compared word by word.
    """

    length: int
    shift: dict[tuple[bytes, ...], int] = field(default_factory=dict)
    buckets: dict[tuple[bytes, ...], dict[tuple[bytes, ...], list[str]]] = field(default_factory=dict)

    @property
    def block(self) -> int:
        return min(2, self.length)

    def add(self, window: tuple[bytes, ...], item: str) -> None:
        bucket = self.buckets.setdefault(window[-self.block :], {})
        if (items := bucket.get(window)) is not None:
            if item not in items[-1:]:
                items.append(item)
            return
        bucket[window] = [item]
        for end in range(self.block, self.length):
            key = window[end - self.block : end]
            self.shift[key] = min(self.shift.get(key, self.length), self.length - end)

    def search(self, words: Words) -> Iterator[tuple[int, list[str]]]:
        """``(end, items)`` of every occurrence, in order."""
        n, length, block = len(words), self.length, self.block
        shift, buckets, far = self.shift.get, self.buckets.get, self.length - self.block + 1
        end = length
        while end <= n:
            key = (words[end - 2], words[end - 1]) if block == 2 else (words[end - 1],)
            bucket = buckets(key)
            if bucket is None:
                end += shift(key, far)
                continue
            if items := bucket.get(tuple(words[end - length : end])):
                yield end, items
            end += 1


@dataclass
class Searcher:
    """All windows of a block: the full ones together, shorter whole items by their length."""

    by_length: dict[int, Patterns] = field(default_factory=dict)

    def add(self, item: str, words: Words, window: int) -> None:
        length = min(window, len(words))
        patterns = self.by_length.setdefault(length, Patterns(length))
        for start in range(len(words) - length + 1):
            patterns.add(tuple(words[start : start + length]), item)

    def search(self, words: Words) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of hit words, merged and in order, and the items found."""
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        for length, patterns in self.by_length.items():
            for end, items in patterns.search(words):
                spans.append((end - length, end))
                found.update(items)
        return merge_spans(spans), found


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def blocks_of(items: Iterable[tuple[str, str | None]], window: int, block_words: int) -> Iterator[Searcher]:
    """Searchers of at most ``block_words`` words; a longer item goes on in the next, its windows whole."""
    searcher, held = Searcher(), 0
    for item, text in items:
        words = words_of(text)
        while words:
            take = max(window, block_words - held)
            if len(words) - take < 1:
                take = len(words)
            searcher.add(item, words[:take], window)
            held += take
            words = words[take - window + 1 :] if take < len(words) else []
            if held >= block_words:
                yield searcher
                searcher, held = Searcher(), 0
    if held:
        yield searcher


def find_windows(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``spans``, ``items`` and ``contaminated``.

    A word is hit if any occurrence of a window covers it; a window is ``window``
    consecutive words of an item, or a whole shorter item. ``spans`` are merged
    ``(start, end)`` in words; ``items`` the ids with occurrences, as text, sorted. Null and
    empty texts have no words, on both sides; a null item id reads as empty text, and
    rows that share an id count as one item. Columns of the five names are replaced.

    The benchmark is read to the driver one block of ``block_words`` words at a time,
    and each block goes over all documents, so that no broadcast grows with it. With more than
    one block each stores only the places and spans of the rows that it hits; texts meet
    these once, after the last block.
    """
    new = ["n_words", "n_hit", "spans", "items", "contaminated"]
    names = [f"c{i}" for i in range(len(docs.columns))]
    words = names[docs.columns.index(text)]
    rows = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")), item_text)
    searchers = blocks_of(rows.toLocalIterator(), window, block_words)
    out = docs.toDF(*names)
    first, second = next(searchers, Searcher()), next(searchers, None)
    if second is None:
        out = out.withColumn("_found", _scan(_shared(docs, first))(words))
    else:
        out = _search_blocks(placed(out, "_tag"), words, chain([first, second], searchers))
    spans = F.zip_with(
        "_found.starts", "_found.ends", lambda s, e: F.struct(s.alias("start"), e.alias("end"))
    )
    hit = F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    found = [F.col("_found.n_words"), hit, spans, F.col("_found.items"), hit > 0]
    kept = [(n, c) for n, c in zip(names, docs.columns, strict=True) if c.lower() not in new]
    return out.select(
        *[F.col(n).alias(c) for n, c in kept], *[c.alias(n) for n, c in zip(new, found, strict=True)]
    )


def _shared(docs: DataFrame, searcher: Searcher) -> Broadcast:
    return docs.sparkSession.sparkContext.broadcast(searcher)


def _search_blocks(docs: DataFrame, text: str, searchers: Iterable[Searcher]) -> DataFrame:
    """``docs``, numbered by ``_tag``, with ``_found`` over all blocks: hits are stored block by block, without texts."""
    hits = []
    for searcher in searchers:
        shared = _shared(docs, searcher)
        found = docs.select("_tag", _scan(shared)(text).alias("_found")).where(F.size("_found.starts") > 0)
        hits.append(stored(found.select("_tag", "_found.starts", "_found.ends", "_found.items")))
        shared.unpersist()
    each = F.collect_list(F.struct("starts", "ends", "items"))
    merged = reduce(DataFrame.unionByName, hits).groupBy("_tag").agg(each.alias("each"))
    merged = merged.select("_tag", *[F.flatten(F.col("each")[c]).alias(c) for c in ("starts", "ends", "items")])
    out = docs.join(merged, "_tag", "left").withColumns(
        {c: F.coalesce(c, F.array().cast(f"array<{kind}>")) for c, kind in (("starts", "int"), ("ends", "int"), ("items", "string"))}
    )
    return out.withColumn("_found", _scan(_shared(docs, Searcher()))(text, "starts", "ends", "items"))


def _scan(shared: Broadcast):
    """A function of the text, and of what earlier blocks have found if there were any."""

    @F.pandas_udf("struct<n_words: long, starts: array<int>, ends: array<int>, items: array<string>>")
    def scan(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        searcher = shared.value
        for batch in batches:
            texts, *before = (batch,) if isinstance(batch, pd.Series) else batch
            rows = []
            for t, *old in zip(texts, *before, strict=True):
                words = words_of(t)
                spans, found = searcher.search(words)
                if old:
                    spans = merge_spans(spans + list(zip(old[0].tolist(), old[1].tolist(), strict=True)))
                    found.update(old[2])
                rows.append((len(words), [s for s, _ in spans], [e for _, e in spans], sorted(found)))
            yield pd.DataFrame(rows, columns=["n_words", "starts", "ends", "items"])

    return scan


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options: int | str) -> DataFrame:
    """The rows of ``docs`` without a benchmark window, with all their columns."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    text = names[docs.columns.index(str(options.pop("text", "text")))]
    found = find_windows(docs.toDF(*names), benchmark, text=text, **options)
    return found.where("NOT contaminated").select(*names).toDF(*docs.columns)


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
starts AS (
  SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i
  FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS t FROM starts),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d JOIN sizes ON len(w) >= n),
hits AS (
  SELECT p.doc_id, p.i, p.n, windows.item_id
  FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS t FROM places) p
  JOIN windows ON p.t = windows.t AND p.n = windows.n),
covered AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT doc_id, i, n FROM hits))
  GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""


@query("op8_window_search", SQL)
def op8_window_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_windows(
        table(spark, sf_dir, "documents", "doc_id", "text"),
        table(spark, sf_dir, "benchmark", "item_id", "text"),
    )
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )
