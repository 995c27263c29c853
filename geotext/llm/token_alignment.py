"""Two tokenizers aligned on the bytes of each distinct text, with corpus-wide counts of the ids that end together.

Equal texts meet by a shuffle on the whole text, so each is encoded once and counts for all its copies.

Two tokens that end together are suffixes of one another, so the pairs that can ever be linked are at most
the suffixes of all vocabulary entries: the table of pair counts is bounded by the vocabularies, however
large the corpus is, and can be sent to every worker.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, SparkSession, functions as F
from tokenizers import Tokenizer

from geotext.llm.common import query, stored, table
from geotext.llm.token_counts import byte_symbols
from geotext.operators.skew import attach

BYTE_TOKENIZER = "byte_bpe_50k.json"
PIECE_TOKENIZER = "piece_bpe_32k.model"

#: Segments kept in each half of a worker's memory, and the longest one kept.
KEPT_SEGMENTS = 200_000
KEPT_LENGTH = 48
#: Texts and pairs that a worker hands on at once.
SLICE_TEXTS = 500
SLICE_PAIRS = 1_000_000

# A segment begins where a space or line feed follows anything else: there both tokenizers start anew.
_SEGMENT = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
# Letters, numbers and white space up to here are the same in every library's tables.
_PLAIN = re.compile("[\x00-ſ]*")
#: Other white space, whose runs the byte-level split divides by what follows them.
_OTHER_SPACE = re.compile(r"[^\S \n]")


#: Ids of a stretch by each vocabulary, packed. Tuples of plain values are left alone by the garbage
#: collector, however many are remembered.
Ids = tuple[bytes, bytes]


class Segments(dict):
    """Segments met of late. When it is full, what it holds becomes the older half, from which segments in use return."""

    def __init__(self, encode: Callable[[str], Ids | None]) -> None:
        super().__init__()
        self.encode = encode
        self.older: dict[str, Ids | None] = {}

    def __missing__(self, data: str) -> Ids | None:
        found = self.older[data] if data in self.older else self.encode(data)
        if len(data) <= KEPT_LENGTH:
            if len(self) >= KEPT_SEGMENTS:
                self.older = dict(self)
                self.clear()
            self[data] = found
        return found


class Aligner:
    """Tokens of a space and a text by both vocabularies, cut where both end."""

    def __init__(self, path_a: str, path_b: str) -> None:
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a = self._byte_entries(path_a)
        n = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(n)]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(pieces)
        ]
        self.number = np.dtype("<u4" if len(self.bytes_a) * n <= 1 << 32 else "<u8")
        #: No piece goes on past a space or line feed that follows anything else.
        self.by_segment = not any("\n" in p or "▁" in p.lstrip("▁") for p in pieces)
        self.ranks = self._as_ranks()
        self.lengths_a = np.zeros(max(self.bytes_a) + 1, np.int64)
        self.lengths_a[list(self.bytes_a)] = [len(raw) for raw in self.bytes_a.values()]
        self.lengths_b = np.array([len(raw) for raw in self.bytes_b], np.int64)
        #: Each id as it is written within a group and at its side's end.
        written = [f"{i}{mark}" for i in range(self.lengths_a.size) for mark in ",|"]
        self.written = np.array(written + [f"{i}{mark}" for i in range(n) for mark in ",;"], "S")
        self.segments = Segments(self.segment)

    def _byte_entries(self, path: str) -> dict[int, bytes]:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        before = spec["pre_tokenizer"]
        if before["type"] != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"] or spec["normalizer"]:
            raise ValueError(f"{path}: only byte-level vocabularies without a normaliser are aligned")
        byte_of = {c: b for b, c in byte_symbols().items()}
        vocab = spec["model"]["vocab"]
        self.added_a = {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.entry_a = {i: entry for entry, i in vocab.items()}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        #: Ids in the order of the merges that make them.
        self.merged = [vocab[a + b] for a, b in pairs]
        return {
            i: entry.encode() if i in self.added_a else bytes(byte_of[c] for c in entry)
            for i, entry in self.entry_a.items()
        }

    def _as_ranks(self) -> tiktoken.Encoding | None:
        """The same merges by the rank of what they make, which is faster, or None where that could differ.

        Ids must follow the order of the merges, and each entry alone must merge to itself. Then two neighbours whose
        union is an entry are always the two that it is merged from: what merges inside a stretch does
        not depend on what is around it, and the entry alone has one last pair.
        """
        entries = {raw: i for i, raw in self.bytes_a.items() if i not in self.added_a}
        rank = {i: k for k, i in enumerate(self.merged)}
        ordered = sorted(rank, key=rank.__getitem__) == sorted(rank)
        tokenize = self.a.model.tokenize
        alone = all(len(tokenize(self.entry_a[i])) == 1 for i in entries.values())
        if not ordered or not alone or len(rank) + 256 != len(entries) or max(map(entries.get, map(bytes, zip(range(256))))) >= min(rank):
            return None
        return tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=entries, special_tokens={}
        )

    def pair_bound(self) -> int:
        """No more pairs than this are ever linked: each is an entry with a suffix of it in the other vocabulary."""
        longest = sum(map(len, self.bytes_a.values())) + sum(map(len, self.bytes_b))
        alike = max(pd.Series(self.bytes_b).value_counts().max(), pd.Series(list(self.bytes_a.values())).value_counts().max())
        return longest * int(alike)

    def spelled(self, data: str, a: list[int], b: list[int]) -> Ids | None:
        raw = data.encode()
        if b"".join([self.bytes_a[i] for i in a]) != raw or b"".join([self.bytes_b[i] for i in b]) != raw:
            return None
        return array("I", a).tobytes(), array("I", b).tobytes()

    def whole(self, data: str) -> Ids | None:
        """A space and a text encoded whole; None where the tokens of either do not spell it."""
        return self.spelled(data, self.a.encode(data, add_special_tokens=False).ids, self.b.encode(data[1:]))

    def segment(self, data: str) -> Ids | None:
        # The library puts a space before what it encodes: it stands for the segment's own, or goes.
        b = self.b.encode(data[1:]) if data[0] == " " else self.b.encode(data)[1:]
        if self.ranks is not None and _PLAIN.fullmatch(data):
            return self.spelled(data, self.ranks.encode_ordinary(data), b)
        return self.spelled(data, self.a.encode(data, add_special_tokens=False).ids, b)

    def ids(self, text: str) -> Ids | None:
        """The whole text after a space, a segment at a time where that gives the same tokens."""
        data = " " + text
        if not self.by_segment or _OTHER_SPACE.search(text):
            return self.whole(data)
        segments = self.segments
        parts = [segments[s] for s in _SEGMENT.findall(data)]
        if None in parts:
            return self.whole(data)
        return b"".join([a for a, _ in parts]), b"".join([b for _, b in parts])

    def groups(self, found: Ids) -> tuple[int, int, np.ndarray, bytes]:
        """Tokens of each, the numbers of the linked pairs in order, and the groups as text."""
        a, b = (np.frombuffer(packed, np.uint32).astype(np.int64) for packed in found)
        ends_a, ends_b = np.cumsum(self.lengths_a[a]), np.cumsum(self.lengths_b[b])
        ends = np.zeros(int(ends_a[-1]) + 1, np.int8)
        ends[ends_a] = 1
        ends[ends_b] += 1
        last_a, last_b = ends[ends_a] == 2, ends[ends_b] == 2
        upto_a, upto_b = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1
        # A group's tokens stand after those of all groups before it, first the one side's, then the other's.
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        order = np.empty(a.size + b.size, np.int64)
        order[np.arange(a.size) + np.concatenate([[0], upto_b])[group_a]] = 2 * a + last_a
        order[np.arange(b.size) + upto_a[group_b]] = 2 * (self.lengths_a.size + b) + last_b
        text = self.written[order].tobytes().translate(None, b"\0")[:-1]
        return a.size, b.size, a[last_a] * len(self.bytes_b) + b[last_b], text


@lru_cache(maxsize=2)
def aligner_of(name_a: str, name_b: str) -> Aligner:
    """Once per Python worker."""
    return Aligner(public_tokenizers.path(name_a), public_tokenizers.path(name_b))


_TEXTS = (
    "digest binary, copies long, n_a long, n_b long, n_groups long, n_links long, "
    "groups_sha256 string, pairs binary, times binary"
)


def align_texts(texts: DataFrame, name_a: str = BYTE_TOKENIZER, name_b: str = PIECE_TOKENIZER) -> DataFrame:
    """Of distinct texts ``digest, text, copies``: the counts, and each linked pair with how often it is linked.

    ``pairs`` holds the text's different pair numbers in order, each as its distance from the one before.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner = aligner_of(name_a, name_b)
        for pdf in batches:
            for start in range(0, len(pdf), SLICE_TEXTS):
                some = pdf.iloc[start : start + SLICE_TEXTS]
                rows = [(*ends, *_measured(aligner, text)) for text, *ends in some[["text", "digest", "copies"]].itertuples(False, None)]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in _TEXTS.split(", ")])

    return texts.select("digest", "text", "copies").mapInPandas(run, _TEXTS)


def _measured(aligner: Aligner, text: str) -> tuple:
    found = aligner.ids(text)
    if found is None:
        return 0, 0, 0, 0, "", b"", b""
    n_a, n_b, links, groups = aligner.groups(found)
    pairs, times = np.unique(links.astype(aligner.number), return_counts=True)
    steps = np.diff(pairs, prepend=aligner.number.type(0))
    digest = hashlib.sha256(groups).hexdigest()
    return n_a, n_b, links.size, links.size, digest, steps.tobytes(), times.astype("<u4").tobytes()


def _unpacked(pdf: pd.DataFrame, number: np.dtype) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``row, pair, times``, a bounded number of pairs at once unless one text has more."""
    sizes = (pdf["times"].str.len() // 4).to_numpy(np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < sizes.size:
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] - sizes[start] + SLICE_PAIRS, "right")))
        rows = range(start, stop)
        parts = [np.cumsum(np.frombuffer(pdf["pairs"].iloc[k], number), dtype=number) for k in rows]
        times = np.frombuffer(b"".join(pdf["times"].iloc[start:stop]), "<u4").astype(np.int64)
        yield np.repeat(np.arange(start, stop), sizes[start:stop]), np.concatenate(parts).astype(np.int64), times
        start = stop


def _summed(pairs: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if pairs.size == 0:
        return pairs, n
    order = np.argsort(pairs, kind="stable")
    pairs, n = pairs[order], n[order]
    begins = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
    return pairs[begins], np.add.reduceat(n, begins)


def pair_counts(aligned: DataFrame, number: np.dtype) -> DataFrame:
    """``pair, n``: links of all copies of all texts. Each task hands on a row for each pair it met."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for pdf in batches:
            copies = pdf["copies"].to_numpy(np.int64)
            for row, some, times in _unpacked(pdf, number):
                some, times = _summed(some, times * copies[row])
                pairs, n = _summed(np.concatenate([pairs, some]), np.concatenate([n, times]))
        yield pd.DataFrame({"pair": pairs, "n": n})

    met = aligned.select("copies", "pairs", "times").mapInPandas(run, "pair long, n long")
    return met.groupBy("pair").agg(F.sum("n").alias("n"))


def align_documents(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    name_a: str = BYTE_TOKENIZER,
    name_b: str = PIECE_TOKENIZER,
) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``, one row per row of ``docs``.

    Texts that are null or empty, and those that the tokens of either vocabulary do not spell, have zeros and
    an empty digest. Rows with null or repeated ids stay, and only the id and the text are read. The
    measures of a text find its copies by its SHA-256; a text with very many copies is spread over tasks.
    """
    spark = docs.sparkSession
    here = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    empty = F.coalesce(F.col("text"), F.lit("")) == ""
    digest = F.unhex(F.sha2("text", 256))
    distinct = here.where(~empty).groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    aligned = stored(align_texts(distinct.withColumn("digest", digest), name_a, name_b), "zstd")

    aligner = aligner_of(name_a, name_b)
    number, n_b, bound = aligner.number, len(aligner.bytes_b), aligner.pair_bound()
    counted = pair_counts(aligned, number).toPandas().sort_values("pair", ignore_index=True)
    if len(counted) > bound:
        raise AssertionError(f"{len(counted)} pairs, but the vocabularies allow {bound}")
    highest = counted.groupby(counted["pair"] % n_b)["n"].transform("max")
    known = spark.sparkContext.broadcast(
        (counted["pair"].to_numpy(), counted["n"].to_numpy(), (counted["n"] == highest).to_numpy())
    )

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs, n, best = known.value
        for pdf in batches:
            n_best, count_sum = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
            for row, some, times in _unpacked(pdf, number):
                at = np.searchsorted(pairs, some)
                np.add.at(n_best, row, times * best[at])
                np.add.at(count_sum, row, times * n[at])
            yield pdf.drop(columns=["pairs", "times"]).assign(n_best=n_best, count_sum=count_sum)

    measures = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    schema = ", ".join(["digest binary", "copies long", *[f"{m} long" for m in measures[:4]], "groups_sha256 string"])
    judged = aligned.mapInPandas(judge, schema + ", n_best long, count_sum long")
    met = attach(here.where(~empty).select("doc_id", digest.alias("digest")), judged, ["digest"], count="copies")
    none = here.where(empty).select("doc_id", *[F.lit(0).cast("long").alias(m) for m in measures], F.lit("").alias("groups_sha256"))
    names = ["doc_id", *measures, "groups_sha256"]
    return met.select(names).unionByName(none)


@query("op11_token_alignment")
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(table(spark, sf_dir, "documents", "doc_id", "text"))
