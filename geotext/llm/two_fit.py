"""Best-two-fit packing of token sequences, planned on the histogram of lengths."""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from tokenizers import Tokenizer

from geotext.llm.common import cut, query, table
from geotext.llm.token_counts import byte_symbols

TOKENIZER = "word_bpe_49k.json"
CAPACITY = 4096
END_ID = 1

#: Pieces of one length that are put in order together, at most.
GROUP_ROWS = 200_000

#: Words kept in each half of a worker's memory with their ids, and the longest word kept.
KEPT_WORDS = 300_000
KEPT_LENGTH = 48

# Up to U+017F, without U+0130, lower case is one letter of the same kind, NFC changes nothing,
# and letters, numbers and white space are the ranges below. Other texts, and those with
# strings of added tokens, go through the library whole.
_PLAIN = re.compile("[\x00-įı-ſ]*")
_SPACE = " \t\n\x0b\x0c\r\x85\xa0"
_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ſ"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")
#: The normaliser and the split that this stands for; other vocabularies take the library's way.
_NORMALISER = ["NFC", "Replace", "Lowercase"]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


class WordIds(dict):
    """Packed ids of single words, by the library's model, with the words of late remembered.

    When it is full, what it holds becomes the older half, from which words in use return.
    """

    def __init__(self, tokenizer: Tokenizer) -> None:
        super().__init__()
        self.tokenize = tokenizer.model.tokenize
        self.symbols = {b: s for b, s in byte_symbols().items() if chr(b) != s}
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            symbols = word.encode().decode("latin-1").translate(self.symbols)
            found = packed([t.id for t in self.tokenize(symbols)])
        if len(word) <= KEPT_LENGTH:
            if len(self) >= KEPT_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = found
        return found


class Ids:
    """Ids of texts by the library, a word at a time where words do not depend on each other."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        steps = (spec["normalizer"] or {}).get("normalizers", [])
        splits = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        pattern = splits[0].get("pattern", {}).get("Regex")
        self.by_word = [s["type"] for s in steps] == _NORMALISER and pattern == _SPLIT
        added = [t["content"] for t in spec["added_tokens"]]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.words = WordIds(self.tokenizer)

    def ids(self, text: str) -> bytes:
        """The ids, packed as little-endian unsigned 32-bit numbers."""
        plain = self.by_word and _PLAIN.fullmatch(text) is not None
        if not plain or (self.added is not None and self.added.search(text)):
            return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        words = self.words
        return b"".join([words[w] for w in _WORDS.findall(text.lower())])


@lru_cache(maxsize=2)
def ids_of(path: str) -> Ids:
    """Once per Python worker."""
    return Ids(path)


@dataclass
class Plan:
    """Which sequence the r-th piece of a length goes to, for every length.

    One entry for each run of like sequences and length in them: from rank ``first`` on,
    each sequence from ``sequence`` on takes ``per`` pieces of that length, from
    ``offset`` on. ``keys`` are length and rank in one number, in order.
    """

    span: int
    keys: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    per: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        run = np.searchsorted(self.keys, length * self.span + rank, side="right") - 1
        k, per = rank - self.first[run], self.per[run]
        return self.sequence[run] + k // per, self.offset[run] + k % per * length


def fill(left: np.ndarray, capacity: int) -> list[int]:
    """Lengths of one sequence out of what is ``left`` of each.

    Greedily the longest that fits, again and again. Then, if a gap remains, the shortest
    gives way to the two that fill the gap and its own place most tightly, if they do
    better than it does.
    """
    left = left.copy()
    out: list[int] = []
    gap = capacity
    while (fits := np.flatnonzero(left[: gap + 1])).size:
        longest = int(fits[-1])
        take = min(gap // longest, int(left[longest]))
        out += [longest] * take
        left[longest] -= take
        gap -= take * longest
    if gap and out:
        room, shortest = gap + out[-1], out[-1]
        # below[x]: the longest that is left and at most x.
        below = np.maximum.accumulate(np.where(left[: room + 1] > 0, np.arange(room + 1), 0))
        a = np.flatnonzero(left[: room + 1])
        b = below[room - a]
        alone = (a == b) & (left[a] < 2)
        b = np.where(alone, below[np.maximum(b - 1, 0)], b)
        both = np.where(b > 0, a + b, 0)
        if both.size and (best := int(both.argmax())) >= 0 and both[best] > shortest:
            out[-1:] = sorted((int(a[best]), int(b[best])), reverse=True)
    return out


def make_plan(count: np.ndarray, capacity: int) -> Plan:
    """The plan for ``count[length]`` pieces of each length from 1 to ``capacity``.

    A filling is used for as many sequences as its lengths last, so the steps follow the
    number of lengths, not of pieces: below capacity * ln(capacity), whatever the input.
    """
    left = count.astype(np.int64)
    used = np.zeros_like(left)
    span = int(left.max(initial=0)) + 1
    rows: list[tuple[int, int, int, int, int, int]] = []
    sequence = 0
    while left.any():
        needs = Counter(fill(left, capacity))
        times = min(int(left[n]) // k for n, k in needs.items())
        offset = 0
        for n, k in needs.items():
            first = int(used[n])
            rows.append((n * span + first, first, sequence, k, offset, n))
            used[n] += k * times
            left[n] -= k * times
            offset += k * n
        sequence += times
    runs = np.array(sorted(rows), dtype=np.int64).reshape(-1, 6)
    return Plan(span, *(runs[:, i] for i in range(5)), sequence)


def pieces_of(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    tokenizer: str = TOKENIZER,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``, packed) of every piece of every document."""
    end = np.array([end_id], "<u4").tobytes()

    @F.pandas_udf("array<struct<piece: int, start: long, length: long, ids_crc32: long, ids: binary>>")
    def cut_up(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ids = ids_of(public_tokenizers.path(tokenizer)).ids
        for texts in batches:
            out = []
            for t in texts:
                whole = (ids(t) if t else b"") + end
                parts = [whole[i : i + 4 * capacity] for i in range(0, len(whole), 4 * capacity)]
                out.append(
                    [
                        {
                            "piece": i,
                            "start": i * capacity,
                            "length": len(p) // 4,
                            "ids_crc32": zlib.crc32(p),
                            "ids": p if with_ids else None,
                        }
                        for i, p in enumerate(parts)
                    ]
                )
            yield pd.Series(out)

    found = docs.select(F.col(doc_id).alias("doc_id"), F.inline(cut_up(text)))
    return found if with_ids else found.drop("ids")


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: each has its own place, gapless from 0.

    ``pieces`` has ``doc_id, piece, ids_crc32`` and ``length`` from 1 to ``capacity``; it is
    stored first. Only its histogram of lengths, ``capacity`` numbers, meets the driver, and
    the plan made of it is broadcast: both are bounded by ``capacity`` alone. Pieces of a length are
    numbered in groups of at most ``group_rows``, and of a quarter of a task's share, so a
    length that many pieces have is dealt out. Equal rows take places as they come.
    """
    spark = pieces.sparkSession
    pieces = cut(pieces)
    count = np.zeros(capacity + 1, dtype=np.int64)
    for row in pieces.groupBy("length").count().collect():
        count[row["length"]] = row["count"]
    plan = spark.sparkContext.broadcast(make_plan(count, capacity))
    share = int(count.sum()) // (4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    size = max(1, min(group_rows, share))
    groups = [(n, int(-(-c // size))) for n, c in enumerate(count.tolist()) if c]
    per_length = spark.createDataFrame(groups, "length long, groups int")
    dealt = pieces.join(F.broadcast(per_length), "length").withColumn(
        "_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("groups"))
    )
    sizes = dealt.groupBy("length", "_group").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "_group", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    order = Window.partitionBy("length", "_group").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        dealt.withColumn("_rank", F.row_number().over(order) - 1)
        .join(starts, ["length", "_group"])
        .withColumn("_rank", F.col("_rank") + F.col("_from"))
    )

    @F.pandas_udf("struct<sequence_id: long, offset: long>")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = plan.value.place(length.to_numpy(), rank.to_numpy())
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    placed = ranked.withColumn("_place", place("length", "_rank"))
    return placed.select(*pieces.columns, "_place.sequence_id", "_place.offset")


def pack_documents(docs: DataFrame, with_ids: bool = False, capacity: int = CAPACITY, **options: str) -> DataFrame:
    """Every document of ``docs`` in sequences of at most ``capacity`` tokens.

    A null text is an empty one: its end id alone. Repeated rows and null ids are packed like
    others; columns other than the id and the text are not read. Only documents longer than a sequence
    are cut. See ``pieces_of`` for the options and ``pack`` for the columns.
    """
    return pack(pieces_of(docs, capacity=capacity, with_ids=with_ids, **options), capacity)


def sequences(placed: DataFrame) -> DataFrame:
    """``sequence_id, ids, doc_ids``: the packed ids of each sequence, from pieces with ``ids``.

    A sequence has at most its capacity of pieces, so its group is bounded.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))
    return placed.groupBy("sequence_id").agg(parts.alias("_parts")).select(
        "sequence_id",
        F.aggregate("_parts", F.lit(b""), lambda all_, p: F.concat(all_, p["ids"])).alias("ids"),
        F.transform("_parts", lambda p: p["doc_id"]).alias("doc_ids"),
    )


@query("op3_two_fit")
def op3_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return pack_documents(docs)
