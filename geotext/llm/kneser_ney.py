"""Toxicity by two Kneser-Ney models of word pairs, one of toxic and one of ordinary texts.

Words and pairs are known by hashes of 64 bits. Every pair of every learned text is counted, and every
counted pair and word keeps an estimate of its own, in a stored Spark table that grows with what is
learned. A log-likelihood is a sum over a text's words and pairs, so texts meet the table in a join. Of the table only the commonest
rows are broadcast, so that common keys need not be shuffled; all others are found by the join. The table is stored in buckets of its
keys and stays where it is; texts meet it a share at a time, so that no more than a share's words and pairs lie on the disks. A row is known
by its place in the table, so that no two texts are taken for one.

The score compares, per word, the likelihoods of the whole text by pairs and those of its most telling words, since a few
expressions make a long text toxic.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType

from geotext.llm.common import Buckets, crc_share, forget, placed, query, short_shuffles, sigmoid_of, stored, table
from geotext.llm.labelled import bounded_sample, fit_logistic, one_label
from geotext.llm.window_search import words_of

#: One in so many learned rows, at most, is kept from the counts, to calibrate on.
CALIBRATION_SHARE = 8
#: About so many are enough, two numbers each.
CALIBRATION_ROWS = 20_000
THRESHOLD = 0.7

#: Rows of the table that every worker holds, the commonest; the others are joined.
KNOWN_KEYS = 1_000_000
#: So many of the commonest words are broadcast to the pairs; pairs of other words meet theirs by shuffle.
BROADCAST_WORDS = 150_000
#: Words are dealt to so many parts by their hash; of each part a text's most telling word is noted.
WORD_PARTS = 8
#: The most telling words, of different parts, over which their log-likelihoods are averaged.
TELLING_WORDS = 2
#: Texts worked on at once.
TEXTS = 500

#: Words whose hashes a worker remembers.
KEPT_WORDS = 300_000

#: Learned texts are counted in so many passes, each of which shuffles its share of the pairs. A share is deleted when it has its estimates.
COUNT_PASSES = 2
#: Rows of the table in one bucket, which one task holds while texts pass by.
BUCKET_ROWS = 300_000
#: Shares of the texts that meet the table one after the other, so that only one share's words and pairs are shuffled at a time.
TEXT_SHARES = 4


class WordHashes(dict):
    """Hash of a word in 64 bits, signed, remembered for a bounded number of words. 0 begins a text."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        found = self[word] = int.from_bytes(xxhash.xxh3_64_digest(word), "big", signed=True)
        return found

    def of(self, text: str | None) -> np.ndarray:
        """The hashes of a text's words; words are runs of ASCII letters, digits and non-ASCII."""
        words = words_of(text)
        return np.array(itemgetter(*words)(self) if len(words) > 1 else [self[w] for w in words], np.int64)


def discounts(counts: np.ndarray) -> np.ndarray:
    """By Chen and Goodman: for counts 0, 1, 2 and more."""
    return discounts_of(np.bincount(np.minimum(counts, 5).astype(np.int64), minlength=6).astype(float))


def discounts_of(n: np.ndarray) -> np.ndarray:
    """The same from how many counts are 0, 1, 2 and so on."""
    y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    return np.array([0.0] + [max(0.05, k - (k + 1) * y * n[k + 1] / n[k]) if n[k] else 0.5 for k in (1, 2, 3)])


def pair_keys(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Hash of 64 bits of two words' hashes."""
    with np.errstate(over="ignore"):
        h = before.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9) + after.astype(np.uint64)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0xBF58476D1CE4E5B9)
        return (h ^ (h >> np.uint64(31))).view(np.int64)


def words_before(words: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], words[:-1]]).astype(np.int64) if words.size else words


@F.pandas_udf(LongType())
def pair_key(before: pd.Series, after: pd.Series) -> pd.Series:
    return pd.Series(pair_keys(before.to_numpy(), after.to_numpy()))


def count_all(learn: DataFrame, turn: int = 0, turns: int = 1) -> DataFrame:
    """``before, after, n0, n1``: how often each pair of words occurs in texts of either label.

    Of ``turns`` shares of the pairs only that numbered ``turn``.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers = WordHashes()
        for pdf in batches:
            for start in range(0, len(pdf), TEXTS):
                for label, group in pdf.iloc[start : start + TEXTS].groupby("label"):
                    texts = [numbers.of(t) for t in group["text"]]
                    after = np.concatenate(texts)
                    before = np.concatenate([words_before(w) for w in texts])
                    keys = pair_keys(before, after)
                    if turns > 1:
                        mine = keys % turns == turn
                        keys, before, after = keys[mine], before[mine], after[mine]
                    _, at, n = np.unique(keys, return_index=True, return_counts=True)
                    zero = np.zeros_like(n)
                    both = {"n0": zero if label else n, "n1": n if label else zero}
                    yield pd.DataFrame({"before": before[at], "after": after[at], **both})

    rows = learn.select("text", "label").mapInPandas(count, "before long, after long, n0 long, n1 long")
    return rows.groupBy("before", "after").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


@dataclass
class Estimates:
    """Log probabilities of both classes for all that was counted, less those of unknown words.

    ``rows``: ``key, n, x0, x1, y0, y1``. For a word ``x`` is its log probability after any other, ``y`` the log
    weight of that after this word. For a pair ``x`` is what its own estimate adds to those two.
    ``unknown``: the log probability of a word that was never counted; after one, the weight is 1.
    """

    table: Buckets
    unknown: tuple[float, float]

    @property
    def rows(self) -> DataFrame:
        return self.table.rows


def estimate(learn: DataFrame) -> Estimates:
    """Both models from ``learn (text, label)``: every pair of every row is counted; only totals meet the driver.

    Each class backs off from pairs to how many words its words follow, and from there to the same counts of both
    classes together, so that what is rare in both tells little.
    """
    texts = stored(learn.select("text", "label"), "zstd")
    parts = [stored(count_all(texts, k, COUNT_PASSES)) for k in range(COUNT_PASSES)]
    forget(texts)
    pairs = reduce(DataFrame.unionByName, parts)
    kinds = [(F.col(f"n{c}") > 0).cast("long") for c in (0, 1)]
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")

    def role(word: str, *values: Column) -> Column:
        return F.struct(F.col(word).alias("word"), *[v.alias(k) for k, v in zip(names, values, strict=True)])

    # Of each word: how often and before how many others it comes in either class, and after how many.
    names = ["t0", "t1", "f0", "f1", "k0", "k1", "k2"]
    roles = F.array(
        role("before", F.col("n0"), F.col("n1"), *kinds, zero, zero, zero),
        role("after", zero, zero, zero, zero, *kinds, one),
    )
    words = pairs.select(F.inline(roles)).groupBy("word").agg(*[F.sum(k).alias(k) for k in names])
    words = words_table = stored(words)
    spots = [F.count_if(F.col(f"k{c}") == k).alias(f"k{c}_{k}") for c in range(3) for k in range(1, 5)]
    more = [F.count_if(F.col(f"k{c}") >= 3).alias(f"k{c}_more") for c in range(3)]
    sums = [F.coalesce(F.sum(f"k{c}"), F.lit(0)).alias(f"k{c}_all") for c in range(3)]
    seen = words.agg(*spots, *more, *sums, F.count_if(F.col("k2") > 0).alias("words"), F.count(F.lit(1)).alias("all"))
    seen = seen.first()

    def lower(c: int, back: tuple[Column, float]) -> tuple[Column, float]:
        """Probability of a word by how many words it follows, backed off to ``back``; and of a word never counted."""
        total = seen[f"k{c}_all"]
        known, never = back
        if not total:
            return known, never
        d = discounts_of(np.array([0, *[seen[f"k{c}_{k}"] for k in range(1, 5)], 0], dtype=float))
        lost = seen[f"k{c}_1"] * min(d[1], 1) + seen[f"k{c}_2"] * min(d[2], 2) + seen[f"k{c}_more"] * d[3]
        n = F.col(f"k{c}")
        cut = F.when(n == 0, 0.0).when(n == 1, float(d[1])).when(n == 2, float(d[2])).otherwise(float(d[3]))
        return (n - F.least(cut, n.cast("double")) + F.lit(float(lost)) * known) / total, float(lost) * never / total

    base = 1 / (seen["words"] + 1)
    shared = lower(2, (F.lit(base), base))
    alone = [lower(c, shared) for c in (0, 1)]

    spots = pairs.agg(
        *[F.count_if(F.col(f"n{c}") == k).alias(f"n{c}_{k}") for c in (0, 1) for k in (1, 2)], F.count(F.lit(1)).alias("all")
    ).first()
    once, twice = (np.array([spots[f"n{c}_{k}"] for c in (0, 1)], dtype=float) for k in (1, 2))
    cuts = np.where(once > 0, once / np.maximum(once + 2 * twice, 1), 0.5)

    def weight(c: int) -> Column:
        return F.when(F.col(f"t{c}") > 0, float(cuts[c]) * F.col(f"f{c}") / F.col(f"t{c}")).otherwise(1.0)

    words = words.select(
        "word",
        "t0",
        "t1",
        (F.col("t0") + F.col("t1") + F.col("k2")).alias("n"),
        *[F.log(alone[c][0]).alias(f"a{c}") for c in (0, 1)],
        *[F.log(weight(c)).alias(f"g{c}") for c in (0, 1)],
    )
    first = words.select(F.col("word").alias("before"), "t0", "t1", "g0", "g1", "n")
    last = words.select(F.col("word").alias("after"), "a0", "a1", "n")
    least = least_common(words, BROADCAST_WORDS)
    common = F.lit(False) if least is None else _level() >= least

    def of_words(some: DataFrame) -> DataFrame:
        near, far = first.where(common).drop("n"), last.where(common).drop("n")
        met = some.join(F.broadcast(near), "before", "left").join(F.broadcast(far), "after", "left")
        both = F.col("g0").isNotNull() & F.col("a0").isNotNull()
        rare = met.where(~both).select(some.columns)
        # Sort-merge joins, which Spark splits where one word has many pairs.
        rare = rare.join(first.drop("n").hint("merge"), "before").join(last.drop("n").hint("merge"), "after")
        return met.where(both).unionByName(rare)

    own = []
    for c in (0, 1):
        backed = F.col(f"g{c}") + F.col(f"a{c}")
        kept = F.greatest(F.col(f"n{c}") - float(cuts[c]), F.lit(0.0)) / F.greatest(F.col(f"t{c}"), F.lit(1))
        own.append((F.log(kept + F.exp(backed)) - backed).cast("float").alias(f"x{c}"))
    nothing = [F.lit(0.0).cast("float").alias(f"y{c}") for c in (0, 1)]
    unknown = tuple(float(np.log(alone[c][1])) for c in (0, 1))
    held = Buckets(learn.sparkSession, "key", max(1, -(-(spots["all"] + seen["all"]) // BUCKET_ROWS)))
    held.add(
        words.select(
            F.col("word").alias("key"),
            (F.col("t0") + F.col("t1")).alias("n"),
            *[(F.col(f"a{c}") - unknown[c]).cast("float").alias(f"x{c}") for c in (0, 1)],
            *[F.col(f"g{c}").cast("float").alias(f"y{c}") for c in (0, 1)],
        )
    )
    for some in parts:
        held.add(of_words(some).select(pair_key("before", "after").alias("key"), (F.col("n0") + F.col("n1")).alias("n"), *own, *nothing))
        forget(some)
    forget(words_table)
    return Estimates(held, unknown)


def _level() -> Column:
    """Eight to a doubling of ``n``."""
    return F.floor(F.log2(F.col("n") + 1) * 8)


def least_common(rows: DataFrame, limit: int) -> int | None:
    """The lowest level such that at most ``limit`` rows have an ``n`` of it or more; None if there is none."""
    least, held = None, 0
    for at, n in sorted(rows.groupBy(_level().alias("level")).count().toArrow().to_pandas().to_numpy().tolist())[::-1]:
        held += n
        if held > limit:
            break
        least = at
    return least


def commonest(rows: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys, in order, and values of at most ``limit`` rows with the highest ``n``."""
    least = least_common(rows, limit)
    some = rows.where(_level() >= least) if least is not None else rows.limit(0)
    got = some.select("key", "x0", "x1", "y0", "y1").toArrow().to_pandas().sort_values("key")
    return got["key"].to_numpy(np.int64), got[["x0", "x1", "y0", "y1"]].to_numpy(np.float32)


class Known:
    """The rows of ``commonest`` in a task."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values
        # Most of what is asked differs from all keys in its first 24 bits already.
        self.begins = np.zeros(1 << 24, bool)
        self.begins[self._begin(keys)] = True

    @staticmethod
    def _begin(key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) >> np.uint64(40)).astype(np.int64)

    def look_up(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the keys are known, and the values of those."""
        maybe = np.flatnonzero(self.begins[self._begin(key)])
        spot = np.searchsorted(self.keys, key[maybe])
        same = self.keys[np.minimum(spot, max(self.keys.size - 1, 0))] == key[maybe] if self.keys.size else np.zeros(0, bool)
        held = np.zeros(key.size, bool)
        held[maybe[same]] = True
        return held, self.values[spot[same]]


def text_features(docs: DataFrame, found: Estimates, known_keys: int | None = None) -> DataFrame:
    """``row_tag, ordinary, toxic, telling`` for each row of ``docs (row_tag, text)``.

    ``ordinary`` and ``toxic`` are log-likelihoods per word. ``telling`` is the mean difference of the two over the
    ``TELLING_WORDS`` words that tell most, by themselves; none tells less than nothing, and of a part of the words only one is taken.
    """
    known = docs.sparkSession.sparkContext.broadcast(commonest(found.rows, KNOWN_KEYS if known_keys is None else known_keys))
    gap = found.unknown[1] - found.unknown[0]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Known(*known.value)
        numbers = WordHashes()
        for batch in batches:
            for start in range(0, batch.num_rows, TEXTS):
                tags, texts = batch.slice(start, TEXTS).columns
                yield ask_some(tags.to_numpy(), [numbers.of(t) for t in texts.to_pylist()], held, gap)

    def of_share(k: int) -> DataFrame:
        some = docs.select("row_tag", "text").where(F.pmod(F.xxhash64("row_tag"), F.lit(TEXT_SHARES)) == k)
        return _features(some.mapInArrow(ask, "row_tag long, key long, n int, m int, sums array<float>"), found, gap)

    return reduce(DataFrame.unionByName, [stored(of_share(k)) for k in range(TEXT_SHARES)])


def _features(asked: DataFrame, found: Estimates, gap: float) -> DataFrame:
    # The table lies in buckets, each held by a task; what is asked streams past, so that a key asked for by many texts costs no memory.
    met = asked.join(found.rows.drop("n").hint("shuffle_hash"), "key", "left")
    # Of a pair that was never counted nothing comes: it need not be summed.
    met = met.where(F.col("x0").isNotNull() | (F.col("m") >= 0) | F.col("sums").isNotNull())
    word = (F.col("m") >= 0) & (F.col("n") > 0)
    # What was never counted has the log probabilities of unknown words.
    apart = F.coalesce(F.col("x1") - F.col("x0"), F.lit(0.0)) + gap
    here = [F.coalesce(F.col("sums")[i], F.lit(0.0)) for i in range(3)]
    parts = [F.col("n") * F.col(f"x{c}") + F.greatest("m", F.lit(0)) * F.col(f"y{c}") for c in (0, 1)]
    part = F.pmod("key", F.lit(WORD_PARTS))
    most = [F.max(F.greatest(F.col("sums")[3 + i], F.when(word & (part == i) & (apart > 0), apart.cast("float")))) for i in range(WORD_PARTS)]
    total = met.groupBy("row_tag").agg(
        *[F.sum(here[i] + F.coalesce(parts[i], F.lit(0.0))).alias(f"s{i}") for i in (0, 1)],
        F.sum(here[2]).alias("words"),
        F.reverse(F.array_sort(F.array(*[F.coalesce(m, F.lit(0.0).cast("float")) for m in most]))).alias("most"),
    )
    none = F.col("words") == 0

    def mean(column: str, of_unknown: float) -> Column:
        return F.when(none, 0.0).otherwise(F.col(column) / F.col("words") + of_unknown)

    telling = sum((F.col("most")[i] for i in range(1, TELLING_WORDS)), F.col("most")[0]).cast("double") / TELLING_WORDS
    return total.select(
        "row_tag",
        mean("s0", found.unknown[0]).alias("ordinary"),
        mean("s1", found.unknown[1]).alias("toxic"),
        telling.alias("telling"),
    )


def ask_some(tags: np.ndarray, words: list[np.ndarray], known: Known, gap: float) -> pa.RecordBatch:
    """The words and pairs of some texts that are not ``known``, and one row a text with the sums over those that are.

    ``n`` and ``m`` are how often a word comes after and before another; a pair has ``m`` = -1. ``sums``: ordinary,
    toxic, number of words, and of each part of the words the highest difference above nothing.
    """
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    befores = [words_before(w) for w in words]
    ends = np.cumsum([w.size for w in words])[:-1]
    pairs = np.split(pair_keys(np.concatenate(befores), np.concatenate(words)), ends)
    for w, before, own in zip(words, befores, pairs, strict=True):
        pair, times = np.unique(own, return_counts=True)
        # What comes before a word is the beginning or any word but the last.
        single, n = np.unique(np.concatenate([w, before[:1]]), return_counts=True)
        m = n.copy()
        if w.size:
            n[np.searchsorted(single, 0)] -= 1
            m[np.searchsorted(single, w[-1])] -= 1
        parts.append((np.concatenate([single, pair]), np.concatenate([n, times]), np.concatenate([m, np.full(pair.size, -1)])))
    key, n, m = (np.concatenate([p[i] for p in parts]).astype(np.int64) for i in range(3))
    of = np.repeat(np.arange(len(words)), [p[0].size for p in parts])
    held, x = known.look_up(key)
    x = x.astype(float)
    sums = np.zeros((len(words), 3 + WORD_PARTS), np.float32)
    for c in (0, 1):
        sums[:, c] = np.bincount(of[held], n[held] * x[:, c] + np.maximum(m[held], 0) * x[:, 2 + c], len(words))
    sums[:, 2] = [w.size for w in words]
    is_word = (m[held] >= 0) & (n[held] > 0)
    apart = (x[:, 1] - x[:, 0] + gap)[is_word]
    np.maximum.at(sums, (of[held][is_word], 3 + key[held][is_word] % WORD_PARTS), apart)
    rest = ~held
    # A text's own row is counted no times, so that a pair whose key is such a number adds nothing.
    some, none = int(rest.sum()), np.zeros(tags.size, np.int64)
    at = np.r_[np.zeros(some, np.int32), np.arange(tags.size + 1, dtype=np.int32) * sums.shape[1]]
    empty = np.r_[np.ones(some, bool), np.zeros(tags.size + 1, bool)]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.r_[tags[of[rest]], tags]),
            pa.array(np.r_[key[rest], tags]),
            pa.array(np.r_[n[rest], none].astype(np.int32)),
            pa.array(np.r_[m[rest], none - 1].astype(np.int32)),
            pa.ListArray.from_arrays(pa.array(at, mask=empty), pa.array(sums.ravel())),
        ],
        names=["row_tag", "key", "n", "m", "sums"],
    )


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    threshold: float = THRESHOLD,
    calibration_share: int = CALIBRATION_SHARE,
    calibration_rows: int = CALIBRATION_ROWS,
) -> DataFrame:
    """``docs`` with ``log_ordinary``, ``log_toxic`` (per word), ``score`` and ``predicted``.

    The score is a logistic function of two differences between log-likelihoods per word: of the whole text, and of its
    most telling words alone. It is calibrated on one in ``calibration_share`` learned documents, or fewer
    so that they are about ``calibration_rows``, that the counts leave out. Only rows where ``learn`` holds teach. A text without words (empty, null)
    has zeros and the score of these. Without labels of both kinds every score is
    the share of label 1, and 0 without any. Columns of the four names are replaced, all others stay whatever their names; rows,
    repeats and null ids too, stay. Every counted pair and word keeps its estimate.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    with short_shuffles(docs.sparkSession):
        judged = _judged(docs, names, labels, learn, doc_id, text, label, threshold, calibration_share, calibration_rows)[1]
    new = ["log_ordinary", "log_toxic", "score", "predicted"]
    old = [F.col(c).alias(k) for c, k in zip(names, docs.columns, strict=True) if k not in new]
    return judged.select(*old, *[F.col(f"_{k}").alias(k) for k in new])


def _judged(
    docs: DataFrame,
    names: list[str],
    labels: DataFrame,
    learn: Column | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    threshold: float = THRESHOLD,
    calibration_share: int = CALIBRATION_SHARE,
    calibration_rows: int = CALIBRATION_ROWS,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``docs`` under other ``names`` with ``row_tag``; the same with verdicts; and the stored table of likelihoods."""
    teaches = F.lit(True) if learn is None else learn
    rows = placed(docs.select("*", teaches).toDF(*names, "_learn"))
    at_id, at_text = (names[docs.columns.index(k)] for k in (doc_id, text))
    texts = rows.select("row_tag", F.col(at_text).alias("text"))
    known = one_label(labels, label, doc_id)
    learned = rows.where("_learn").select(F.col(at_id).alias("doc_id"), F.col(at_text).alias("text"), "row_tag")
    # Whole texts need not be sorted by their ids.
    taught = learned.join(known.hint("shuffle_hash"), "doc_id")
    # No more than calibration takes: all other rows teach.
    share = max(calibration_share, -(-taught.count() // calibration_rows))
    held = F.pmod(F.xxhash64("doc_id", F.lit("calibrate")), F.lit(share)) == 0
    estimates = estimate(taught.where(~held))
    found = text_features(texts, estimates)
    estimates.table.drop()
    kept = taught.where(held).select("doc_id", "label", "row_tag").join(found.hint("merge"), "row_tag")
    # Twice as many if ids fall so: what is left out is used.
    few = bounded_sample(kept.drop("row_tag"), 2 * calibration_rows).toArrow().to_pandas()
    x = np.c_[few["toxic"] - few["ordinary"], few["telling"]].astype(float)
    y = few["label"].to_numpy(dtype=float)
    if not few.size or y.min() == y.max():
        rate = taught.agg(F.avg("label")).first()[0]
        y, x = np.full(1, rate or 0.0), np.zeros((1, 2))
    weights, start = fit_logistic(x, y)
    linear = (F.col("toxic") - F.col("ordinary")) * float(weights[0]) + F.col("telling") * float(weights[1]) + float(start)
    scored = found.select(
        "row_tag", F.col("ordinary").alias("_log_ordinary"), F.col("toxic").alias("_log_toxic"), sigmoid_of(linear).alias("_score")
    ).withColumn("_predicted", (F.col("_score") >= threshold).cast("int"))
    rows = rows.drop("_learn")
    return rows, rows.join(scored.hint("merge"), "row_tag"), found


def drop_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    with short_shuffles(docs.sparkSession):
        rows, judged, found = _judged(docs, names, labels, **options)
        # Whole rows need not meet scores, only the few toxic numbers.
        toxic = stored(judged.where("_predicted = 1").select("row_tag"))
    forget(found)
    return rows.join(toxic, "row_tag", "left_anti").select(*names).toDF(*docs.columns)


@query("op2_kneser_ney")
def op2_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    held_out = crc_share(F.col("doc_id"), 3) == 1
    scored = score_toxicity(docs, table(spark, sf_dir, "labels"), learn=~held_out)
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", "predicted", "log_ordinary", "log_toxic"
    )
