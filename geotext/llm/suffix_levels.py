"""Repeated passages by a logarithmic family of sampled suffix arrays.

Suffixes are sampled at anchors: of the ``PREFIX``-byte strings that begin inside a passage of
``LENGTH`` bytes, the one with the lowest hash. Equal passages have the same anchor at the
same place, so a passage can repeat only if its anchor does. A suffix array
of a batch holds its anchors in the order of their hashed prefixes; a new batch is
merge-scanned against the array of each level, and arrays of equal size become one of the next level.
What surrounds the repeated anchors is then compared byte by byte.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from geotext.llm.common import cut, placed, query, table

LENGTH = 400
#: A power of two below ``LENGTH``.
PREFIX = 128
BATCHES = 4

#: Starts worked on at once; fewer than 2**24, as a place fills that many bits of a key.
STRETCH = 1 << 20

#: Contexts of one anchor that a task compares, some 3 MB; more are compared start by start over the cluster.
GROUP_CONTEXTS = 4096

_PLACE = np.uint64((1 << 24) - 1)
_RANDOM = np.random.default_rng(4)
_BYTE = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64)
_FACTORS = _RANDOM.integers(0, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

ANCHORS = "h long, c long, row_tag long, first int, last int, anchor int"


def prefix_hashes(data: np.ndarray, prefix: int) -> np.ndarray:
    """Hash of the ``prefix`` bytes from each place on, by doubling."""
    out, width, step = _BYTE[data], 1, 0
    while width < prefix:
        out = out[:-width] * _FACTORS[step] + out[width:]
        width, step = 2 * width, step + 1
    out ^= out >> np.uint64(32)
    out *= _FACTORS[-1]
    return out ^ out >> np.uint64(29)


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours: of a block's end and the next one's beginning."""
    n = keys.size - width + 1
    blocks = -(-keys.size // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: keys.size] = keys
    square = padded.reshape(blocks, width)
    begin = np.minimum.accumulate(square, axis=1).ravel()
    end = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(end[:n], begin[width - 1 : width - 1 + n])


def anchors_of(data: bytes, length: int = LENGTH, prefix: int = PREFIX) -> Iterator[tuple[int, int, int, int]]:
    """``(h, first, last, anchor)``: the starts ``first`` to ``last`` of passages share an anchor with hash ``h``."""
    whole = np.frombuffer(data, np.uint8)
    for start in range(0, len(data) - length + 1, STRETCH):
        hashes = prefix_hashes(whole[start : start + STRETCH + length - 1], prefix)
        keys = hashes & ~_PLACE | np.arange(hashes.size, dtype=np.uint64)
        place = (sliding_least(keys, length - prefix + 1) & _PLACE).astype(np.int64)
        firsts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        lasts = np.append(firsts[1:], place.size) - 1
        anchors = place[firsts]
        h = hashes[anchors].view(np.int64)
        yield from zip(h.tolist(), (start + firsts).tolist(), (start + lasts).tolist(), (start + anchors).tolist(), strict=True)


def signed(number: int) -> int:
    return number - (1 << 64) if number >> 63 else number


def find_anchors(docs: DataFrame, length: int, prefix: int) -> DataFrame:
    """An ``ANCHORS`` row for every run of starts with one anchor, of ``docs (row_tag, text)``.

    ``c`` is the hash of the run's context, all bytes of its passages.
    """

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for tag, text in zip(pdf["row_tag"], pdf["text"], strict=True):
                data = text.encode() if text else b""
                for h, first, last, anchor in anchors_of(data, length, prefix):
                    c = signed(xxhash.xxh3_64_intdigest(data[first : last + length], h & 0xFFFF))
                    rows.append((h, c, tag, first, last, anchor))
            yield pd.DataFrame(rows, columns=["h", "c", "row_tag", "first", "last", "anchor"])

    return docs.mapInPandas(find, ANCHORS)


class SuffixLevels:
    """Arrays ``(h, n)`` in levels: the one of level k holds 2**k batches."""

    def __init__(self) -> None:
        self.levels: dict[int, DataFrame] = {}

    def add(self, anchors: DataFrame) -> DataFrame:
        """Take in a batch; return the ``h`` that it has twice, or shares with a level."""
        array = cut(anchors.groupBy("h").agg(F.count(F.lit(1)).alias("n")).sortWithinPartitions("h"))
        matches = array.where("n > 1").select("h")
        for level in self.levels.values():
            # A sort-merge join: the scan of both arrays side by side.
            matches = matches.union(array.join(level.select("h").hint("merge"), "h").select("h"))
        matches = cut(matches)
        k = 0
        while k in self.levels:
            both = self.levels.pop(k).union(array)
            array = cut(both.groupBy("h").agg(F.sum("n").alias("n")).sortWithinPartitions("h"))
            k += 1
        self.levels[k] = array
        return matches


def repeated_anchors(anchors: DataFrame, batches: int) -> DataFrame:
    """The ``h`` of anchors that occur twice, from batches taken in one after another."""
    family = SuffixLevels()
    batch = F.pmod(F.xxhash64("row_tag"), F.lit(batches))
    found = [family.add(anchors.where(batch == i)) for i in range(batches)]
    out = found[0]
    for some in found[1:]:
        out = out.union(some)
    return out.distinct()


def ranges(numbers: list[int]) -> list[tuple[int, int]]:
    """Runs ``(first, last)`` of ascending numbers."""
    out: list[tuple[int, int]] = []
    for n in numbers:
        if out and n == out[-1][1] + 1:
            out[-1] = (out[-1][0], n)
        else:
            out.append((n, n))
    return out


def compare_contexts(rows: list[tuple[int, int, int, bytes]], length: int) -> list[list[int]]:
    """For each ``(n, anchor, runs, context)`` of one anchor: which of its passages occur again, by place.

    Passages are compared whole, at the same distance from the anchor only.
    """
    at_distance: dict[int, list[int]] = defaultdict(list)
    for i, (_, anchor, runs, _) in enumerate(rows):
        for place in range(runs):
            at_distance[anchor - place].append(i)
    found: list[list[int]] = [[] for _ in rows]
    for distance in sorted(at_distance, reverse=True):
        members = at_distance[distance]
        passages = [rows[i][3][rows[i][1] - distance : rows[i][1] - distance + length] for i in members]
        count: Counter[bytes] = Counter()
        for i, passage in zip(members, passages, strict=True):
            count[passage] += rows[i][0]
        for i, passage in zip(members, passages, strict=True):
            if count[passage] > 1:
                found[i].append(rows[i][1] - distance)
    return found


PARTS = "h long, c long, starts array<struct<first: int, last: int>>"


def repeated_starts(docs: DataFrame, anchors: DataFrame, batches: int, length: int, group_contexts: int) -> DataFrame:
    """``row_tag, first, last``: runs of starts whose passages occur again somewhere."""
    matched = repeated_anchors(anchors, batches)
    # Copies come together here, before anything else: one context, however many have it.
    where = F.struct("row_tag", "first", "last", "anchor")
    contexts = anchors.groupBy("h", "c").agg(F.count(F.lit(1)).alias("n"), F.min(where).alias("at"))
    contexts = cut(contexts.join(matched, "h"))
    kinds = contexts.groupBy("h").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least"))
    # Where each context occurs twice, or there is just one, no bytes are needed.
    open_ = contexts.join(kinds.where("kinds > 1 AND least = 1"), "h")
    texts = _texts(docs, open_, length)
    few = texts.where(F.col("kinds") <= group_contexts)

    def compare(batches_: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame()
        for pdf in batches_:
            held = pd.concat([held, pdf], ignore_index=True) if len(held) else pdf
            done = held["h"] != held["h"].iloc[-1]
            yield _compared(held[done], length)
            held = held[~done]
        if len(held):
            yield _compared(held, length)

    near = few.repartition("h").sortWithinPartitions("h").mapInPandas(compare, PARTS)
    far = _over_cluster(texts.where(F.col("kinds") > group_contexts), length)
    whole = F.array(F.struct(F.lit(0).alias("first"), (F.col("at.last") - F.col("at.first")).alias("last")))
    settled = contexts.where("n > 1").select("h", "c", whole.alias("starts"))
    known = settled.unionByName(near).unionByName(far)
    runs = anchors.join(known.hint("merge"), ["h", "c"]).select("row_tag", F.col("first").alias("from"), F.inline("starts"))
    return runs.select("row_tag", (F.col("from") + F.col("first")).alias("first"), (F.col("from") + F.col("last")).alias("last"))


def _texts(docs: DataFrame, contexts: DataFrame, length: int) -> DataFrame:
    """``h, c, n, kinds, anchor, runs, context``: one occurrence of each context, with its bytes."""
    fields = ["h", "c", "n", "kinds", "at.first", "at.last", "at.anchor"]
    wanted = contexts.groupBy("at.row_tag").agg(F.collect_list(F.struct(*fields)).alias("wanted"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text, wanted in zip(pdf["text"], pdf["wanted"], strict=True):
                data = text.encode()
                for w in wanted:
                    first, last = w["first"], w["last"]
                    rows.append((w["h"], w["c"], w["n"], w["kinds"], w["anchor"] - first, last - first + 1, data[first : last + length]))
            yield pd.DataFrame(rows, columns=["h", "c", "n", "kinds", "anchor", "runs", "context"])

    joined = docs.join(wanted.hint("merge"), "row_tag").select("text", "wanted")
    return cut(joined.mapInPandas(read, "h long, c long, n long, kinds long, anchor int, runs int, context binary"))


def _compared(held: pd.DataFrame, length: int) -> pd.DataFrame:
    out = []
    for h, group in held.groupby("h", sort=False):
        rows = list(zip(group["n"], group["anchor"], group["runs"], group["context"], strict=True))
        for c, n, places in zip(group["c"], group["n"], compare_contexts(rows, length), strict=True):
            if n == 1 and places:
                out.append((h, c, [{"first": a, "last": b} for a, b in ranges(places)]))
    return pd.DataFrame(out, columns=["h", "c", "starts"])


def _over_cluster(texts: DataFrame, length: int) -> DataFrame:
    """The comparison for anchors with very many contexts: every passage by a digest of 128 bits."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for h, c, n, runs, context in zip(pdf["h"], pdf["c"], pdf["n"], pdf["runs"], pdf["context"], strict=True):
                yield pd.DataFrame(
                    {"h": h, "c": c, "n": n, "place": range(runs), "d": [xxhash.xxh3_128_digest(context[i : i + length]) for i in range(runs)]}
                )

    if texts.isEmpty():
        return texts.sparkSession.createDataFrame([], PARTS)
    passages = texts.mapInPandas(spread, "h long, c long, n long, place int, d binary")
    again = passages.groupBy("d").agg(F.sum("n").alias("of")).where("of > 1").select("d")
    hit = passages.where("n = 1").join(again.hint("merge"), "d")
    places = hit.groupBy("h", "c").agg(F.array_sort(F.collect_list("place")).alias("places"))
    single = F.transform("places", lambda p: F.struct(p.alias("first"), p.alias("last")))
    return places.select("h", "c", single.alias("starts"))


def removed_spans(starts: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes under passages from these runs of starts."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(starts):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], last + length))
        else:
            out.append((first, last + length))
    return out


def remove_repeats(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    prefix: int = PREFIX,
    batches: int = BATCHES,
    group_contexts: int = GROUP_CONTEXTS,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_bytes, n_removed, spans, kept_sha256, kept, row_tag``.

    Every byte is removed that lies in a string of ``length`` bytes which starts anywhere else
    too, in the same text or another; ``spans`` are the maximal removed runs ``(start, end)``, ``kept``
    the bytes that are left, which need not be valid text where a letter of more bytes was cut. Null is an empty
    text. Repeated rows repeat each other. Other columns are not read. ``row_tag`` is the
    row's number by ``placed``.
    """
    if prefix & (prefix - 1) or not 0 < prefix < length:
        raise ValueError("the prefix must be a power of two below the length")
    tagged = placed(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    anchors = cut(find_anchors(tagged.select("row_tag", "text"), length, prefix))
    starts = repeated_starts(tagged.select("row_tag", "text"), anchors, batches, length, group_contexts)
    by_row = starts.groupBy("row_tag").agg(F.collect_list("first").alias("firsts"), F.collect_list("last").alias("lasts"))

    @F.pandas_udf("struct<starts: array<int>, ends: array<int>, kept_sha256: string, kept: binary>")
    def clear(texts: pd.Series, firsts: pd.Series, lasts: pd.Series) -> pd.DataFrame:
        rows = []
        for t, f, last in zip(texts, firsts, lasts, strict=True):
            data = t.encode() if t else b""
            spans = [] if f is None else removed_spans(list(zip(f.tolist(), last.tolist(), strict=True)), length)
            edges = [0, *[e for span in spans for e in span], len(data)]
            left = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            rows.append(([s for s, _ in spans], [e for _, e in spans], hashlib.sha256(left).hexdigest(), left))
        return pd.DataFrame(rows, columns=["starts", "ends", "kept_sha256", "kept"])

    done = tagged.join(by_row.hint("merge"), "row_tag", "left").withColumn("_c", clear("text", "firsts", "lasts"))
    spans = F.zip_with("_c.starts", "_c.ends", lambda a, b: F.struct(a.alias("start"), b.alias("end")))
    return done.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_removed"),
        spans.alias("spans"),
        "_c.kept_sha256",
        "_c.kept",
        "row_tag",
    )


@query("op4_suffix_levels")
def op4_suffix_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
    return done.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256"
    )
