"""Language by partial matching: code lengths of a text under a tree of byte contexts per language.

The trees hold contexts of up to three bytes and are frozen after counting, so the cost
of a byte depends on the longest known context before it alone, and all costs can
be tabled once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from geotext.llm.common import crc_share, cut, query, table

ORDER = 3
#: A context of two or three bytes is kept by a language if it has this share of its bytes, so a
#: tree has at most 2 / SHARE such contexts, however much is counted.
SHARE = 1 / 8192
UNKNOWN = "und"

#: Bytes counted or scored at once, and distinct windows held by a counting task.
STRETCH = 1 << 20
HELD_WINDOWS = 2_000_000

#: Every text begins after this.
_START = b" " * ORDER
_LETTER = re.compile(r"[^\W\d_]")


def windows(data: bytes) -> np.ndarray:
    """Each byte with the three before it, the latest in the lowest bits."""
    b = np.frombuffer(_START + data, np.uint8).astype(np.uint32)
    return b[:-3] << np.uint32(24) | b[1:-2] << np.uint32(16) | b[2:-1] << np.uint32(8) | b[3:]


def _merge(window: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(np.concatenate(window), return_inverse=True)
    return found, np.bincount(at, np.concatenate(n), found.size).astype(np.int64)


def count_windows(learn: DataFrame) -> DataFrame:
    """``lang, window, n`` over every byte of ``learn (text, lang)``."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for pdf in batches:
            for lang, group in pdf.groupby("lang"):
                for some in _stretches(group["text"]):
                    new = np.unique(np.concatenate(some), return_counts=True)
                    old = held.get(lang)
                    held[lang] = _merge([old[0], new[0]], [old[1], new[1]]) if old else new
                    if held[lang][0].size > HELD_WINDOWS:
                        yield _rows(lang, *held.pop(lang))
        for lang, (window, n) in held.items():
            yield _rows(lang, window, n)

    counted = learn.select("text", "lang").mapInPandas(count, "lang string, window long, n long")
    return counted.groupBy("lang", "window").agg(F.sum("n").alias("n"))


def _rows(lang: str, window: np.ndarray, n: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"lang": lang, "window": window.astype(np.int64), "n": n.astype(np.int64)})


def _stretches(texts: pd.Series) -> Iterator[list[np.ndarray]]:
    some: list[np.ndarray] = []
    size = 0
    for t in texts:
        some.append(windows(t.encode()))
        size += some[-1].size
        if size >= STRETCH:
            yield some
            some, size = [], 0
    if size:
        yield some


@dataclass
class Trees:
    """Costs in bits of each byte after each context, by language.

    ``contexts[k]`` are the known contexts of k bytes of all languages together, whose numbers follow
    each other from the empty one on; ``cost[256 * number + byte]`` has a column for each language.
    """

    langs: list[str]
    contexts: list[np.ndarray]
    cost: np.ndarray
    index: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"index": None}

    def longest(self) -> np.ndarray:
        """The number of the longest known context for any three bytes; made once per worker."""
        if self.index is None:
            index = np.zeros((256, 256, 256), np.int32)
            number = 1
            for k in range(1, ORDER + 1):
                c = self.contexts[k]
                numbers = np.arange(number, number + c.size, dtype=np.int32)
                last, before, first = c & 255, c >> 8 & 255, c >> 16 & 255
                if k == 1:
                    index[:, :, last] = numbers
                elif k == 2:
                    index[:, before, last] = numbers
                else:
                    index[first, before, last] = numbers
                number += c.size
            self.index = index.reshape(-1)
        return self.index

    def bits(self, data: bytes) -> np.ndarray:
        """Code length of a text in each language."""
        index, total = self.longest(), np.zeros(len(self.langs))
        window = windows(data)
        for start in range(0, window.size, STRETCH):
            some = window[start : start + STRETCH]
            at = index[some >> np.uint32(8)] * 256 + (some & np.uint32(255)).astype(np.int32)
            total += self.cost[at].sum(axis=0, dtype=np.float64)
        return total

    def judge(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or _LETTER.search(text) is None:
            return UNKNOWN, 0.0
        bits = self.bits(text.encode())
        best = int(bits.argmin())
        return self.langs[best], float(1 / np.exp2(np.maximum(bits[best] - bits, -1000)).sum())


def probabilities(seen: list[np.ndarray]) -> np.ndarray:
    """Of each byte after each context (a row), by counts after its suffixes, the longest first.

    Escapes by method C: a context that has been followed by d kinds of bytes lets go of
    d / (n + d). Bytes of a longer context are excluded from the shorter ones; what is
    left at the end is shared by the bytes that no context knows.
    """
    out = np.zeros(seen[0].shape)
    excluded = np.zeros(seen[0].shape, dtype=bool)
    rest = np.ones((len(out), 1))
    for counts in seen:
        n = np.where(excluded, 0, counts)
        total, kinds = n.sum(axis=1, keepdims=True), (n > 0).sum(axis=1, keepdims=True)
        whole = np.maximum(total + kinds, 1)
        out += rest * n / whole
        rest = np.where(total > 0, rest * kinds / whole, rest)
        excluded |= n > 0
    unknown = (~excluded).sum(axis=1, keepdims=True)
    return out + np.where(excluded, 0, rest / np.maximum(unknown, 1))


def make_trees(counts: dict[str, list[pd.DataFrame]]) -> Trees:
    """From each language's kept contexts: for k bytes, rows ``(context, byte, n)``."""
    langs = sorted(counts)
    contexts = [np.zeros(1, np.int64)]
    for k in range(1, ORDER + 1):
        some = [counts[lang][k]["context"].to_numpy() for lang in langs]
        contexts.append(np.unique(np.concatenate(some)).astype(np.int64) if some else np.zeros(0, np.int64))
    size = sum(c.size for c in contexts)
    cost = np.zeros((256 * size, len(langs)), np.float32)
    for column, lang in enumerate(langs):
        dense = []
        for k, rows in enumerate(counts[lang]):
            # One row more, of zeros, for contexts that this language does not know.
            wide = np.zeros((contexts[k].size + 1, 256))
            np.add.at(wide, (np.searchsorted(contexts[k], rows["context"]), rows["byte"]), rows["n"])
            dense.append(wide)
        parts = []
        for k, c in enumerate(contexts):
            for start in range(0, c.size, 1024):
                some = c[start : start + 1024]
                parts.append(probabilities([dense[j][_place(contexts[j], some, j)] for j in range(k, -1, -1)]))
        cost[:, column] = -np.log2(np.maximum(np.concatenate(parts).reshape(-1), 1e-12))
    return Trees(langs, contexts, cost)


def _place(contexts: np.ndarray, of: np.ndarray, k: int) -> np.ndarray:
    """Rows of the last ``k`` bytes of some contexts; the row of zeros where they aren't known."""
    suffix = of & ((1 << 8 * k) - 1)
    at = np.searchsorted(contexts, suffix)
    known = np.append(contexts, -1)[np.minimum(at, contexts.size)] == suffix
    return np.where(known, at, contexts.size)


def fit(learn: DataFrame, share: float = SHARE) -> Trees:
    """Trees of every language of ``learn (text, lang)``, from all its bytes.

    The driver meets the contexts that are kept and what follows them: for each
    language at most ``2 / share + 257`` contexts. Memory grows with the number of languages.
    """
    counts = cut(count_windows(learn))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    found: dict[str, list[pd.DataFrame]] = {}
    for k in range(ORDER + 1):
        window = F.col("window").bitwiseAND((1 << 8 * (k + 1)) - 1)
        rows = counts.groupBy("lang", window.alias("window")).agg(F.sum("n").alias("n"))
        rows = rows.select("lang", F.shiftright("window", 8).alias("context"), F.col("window").bitwiseAND(255).alias("byte"), "n")
        if k > 1:
            sizes = rows.groupBy("lang", "context").agg(F.sum("n").alias("size"))
            kept = sizes.join(totals, "lang").where(F.col("size") >= F.col("total") * share)
            rows = rows.join(kept.select("lang", "context"), ["lang", "context"], "left_semi")
        for lang, group in rows.toArrow().to_pandas().groupby("lang"):
            found.setdefault(lang, []).append(group)
    none = pd.DataFrame({"context": [], "byte": [], "n": []}, dtype=np.int64)
    return make_trees({lang: (rows + [none] * ORDER)[: ORDER + 1] for lang, rows in found.items()})


def predict_language(
    docs: DataFrame,
    learn: Column | None = None,
    text: str = "text",
    lang: str = "lang",
    share: float = SHARE,
) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, learned from its rows with a language where ``learn`` holds.

    The language with the shortest code is predicted, of equal ones the first by name; the
    score is its share when all languages are equally likely beforehand. A null text, one
    without a letter, and every text if no language is known, get ``und`` and 0. The
    empty language name is a name. Columns of the two names are replaced; rows stay.
    """
    known = F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.octet_length(text) > 0)
    taught = docs.where(known if learn is None else known & learn)
    trees = fit(taught.select(F.col(text).alias("text"), F.col(lang).alias("lang")), share)
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    @F.pandas_udf("struct<lang_pred: string, score: double>")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([shared.value.judge(t) for t in texts], columns=["lang_pred", "score"])

    out = docs.withColumn("_judged", judge(text))
    return out.withColumns({"lang_pred": F.col("_judged.lang_pred"), "score": F.col("_judged.score")}).drop("_judged")


@query("op5_context_trees")
def op5_context_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    held_out = crc_share(F.col("doc_id"), 5) == 0
    judged = predict_language(docs, learn=~held_out)
    return judged.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
