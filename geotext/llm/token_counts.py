"""Token counts by byte-pair merging over a heap and a linked list, without making identifiers."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from geotext.llm.common import query, table

TOKENIZER = "byte_bpe_50k.json"
TOKEN_LIMIT = 512

#: Pieces kept in a worker's memory with their counts, and the longest piece kept.
KEPT_PIECES = 400_000
KEPT_LENGTH = 48


def byte_symbols() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte.

    Bytes that print stand for themselves; the others take the code points from 256 on.
    """
    printing = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(printing)]
    return {b: chr(b) for b in printing} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class PairRanks:
    """Merge ranks of a byte-level vocabulary: numbers of two symbols to rank and merged number."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        before = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or before["type"] != "ByteLevel" or spec["normalizer"]:
            raise ValueError(f"{path}: only byte-level BPE without a normaliser is counted")
        if before["add_prefix_space"] or not before["use_regex"]:
            raise ValueError(f"{path}: a prefix space or another split is not supported")
        vocab = spec["model"]["vocab"]
        self.first = {b: vocab[c] for b, c in byte_symbols().items()}
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.pairs.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        special = [t["content"] for t in spec["added_tokens"]]
        #: Strings of added tokens are one token wherever they stand.
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.pieces = regex.compile(public_tokenizers.PATTERN)
        self.kept: dict[str, int] = {}

    def merges(self, data: bytes) -> int:
        """How often two neighbours merge: pop the lowest rank, leftmost first, until none is left."""
        symbol = [self.first[b] for b in data]
        last = len(symbol) - 1
        after = list(range(1, last + 2))
        before = list(range(-1, last))
        pairs = self.pairs
        heap = [
            (found[0], i, symbol[i], symbol[i + 1], found[1])
            for i in range(last)
            if (found := pairs.get((symbol[i], symbol[i + 1])))
        ]
        heapq.heapify(heap)
        done = 0
        while heap:
            _, i, a, b, merged = heapq.heappop(heap)
            j = after[i]
            if symbol[i] != a or j > last or symbol[j] != b:
                continue  # one of the two has merged meanwhile
            done += 1
            symbol[i], symbol[j] = merged, -1
            k = after[i] = after[j]
            if k <= last:
                before[k] = i
                if found := pairs.get((merged, symbol[k])):
                    heapq.heappush(heap, (found[0], i, merged, symbol[k], found[1]))
            h = before[i]
            if h >= 0 and (found := pairs.get((symbol[h], merged))):
                heapq.heappush(heap, (found[0], h, symbol[h], merged, found[1]))
        return done

    def piece(self, piece: str) -> int:
        """Tokens of one piece: its initial symbols minus its merges."""
        n = self.kept.get(piece)
        if n is None:
            data = piece.encode()
            n = len(data) - self.merges(data)
            if len(piece) <= KEPT_LENGTH:
                if len(self.kept) >= KEPT_PIECES:
                    self.kept.clear()
                self.kept[piece] = n
        return n

    def count(self, text: str) -> int:
        if self.special is None or self.special.search(text) is None:
            return self._plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))

    def _plain(self, text: str) -> int:
        pieces = self.pieces.findall(text)
        kept = self.kept
        try:
            return sum([kept[p] for p in pieces])
        except KeyError:
            return sum(map(self.piece, pieces))


@lru_cache(maxsize=2)
def ranks_of(path: str) -> PairRanks:
    """Once per Python worker."""
    return PairRanks(path)


def count_tokens(
    docs: DataFrame, text: str = "text", tokenizer: str = TOKENIZER, limit: int = TOKEN_LIMIT
) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_tokens`` and ``over_limit`` for whole texts.

    Null counts as the empty text: no bytes, no tokens. Columns of these names are
    replaced; rows, repeats too, stay as they are. ``tokenizer`` is a file name of the
    public vocabularies, looked up on the worker. A piece without a break, however long,
    costs n log n.
    """

    @F.pandas_udf("long")
    def tokens(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = ranks_of(public_tokenizers.path(tokenizer)).count
        for texts in series:
            yield pd.Series([count(t) if t else 0 for t in texts], dtype="int64")

    whole = F.col(text)
    return docs.withColumns(
        {
            "n_bytes": F.coalesce(F.octet_length(whole), F.lit(0)).cast("long"),
            "n_tokens": tokens(whole),
        }
    ).withColumn("over_limit", F.col("n_tokens") > limit)


@query("op10_token_counts")
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return count_tokens(docs).select("doc_id", "n_bytes", "n_tokens", "over_limit")
