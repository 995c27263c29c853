"""Document quality: ridge regression on random Fourier features of document statistics.

The features stand for a Gaussian kernel over some twenty statistics of a text. Every labelled
row enters the sums of its partition, which are folded on the executors; isotonic calibration
turns the fitted values into probabilities.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from geotext.llm.common import crc_share, cut, query, table, tree_sum
from geotext.llm.labelled import one_label, pool_adjacent

FEATURES = 256
#: Width of the kernel, in standard deviations of all statistics together.
WIDTH = 4.0
RIDGE = 1.0
#: Steps of the fitted value that calibration tells apart.
STEPS = 1000
THRESHOLD = 0.7

STATISTICS = (
    "log_bytes log_words log_lines mean_word spread_word longest_word distinct_words distinct_pairs "
    "top_word repeated_lines words_a_line upper digits spaces newlines non_ascii stops marks pipes "
    "symbols exclamations brackets shouted no_letters entropy"
).split()

_KINDS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digits": b"0123456789",
    "spaces": b" \t",
    "newlines": b"\n",
    "stops": b".",
    "marks": b",;:'\"?-",
    "pipes": b"|",
    "symbols": b"#$%&*+=@^_`~\\",
    "exclamations": b"!",
    "brackets": b"<>(){}[]/",
}


def statistics(text: str | None) -> list[float]:
    """The statistics of a whole text, in the order of ``STATISTICS``; all 0 for an empty one."""
    if not text:
        return [0.0] * len(STATISTICS)
    data = text.encode()
    n = len(data)
    of_byte = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words, lines = data.split(), data.split(b"\n")
    share = of_byte[of_byte > 0] / n
    out = dict.fromkeys(STATISTICS, 0.0)
    out["log_bytes"], out["log_lines"] = math.log1p(n), math.log(len(lines))
    out["words_a_line"] = math.log1p(len(words) / len(lines))
    out["non_ascii"] = float(of_byte[128:].sum()) / n
    out["entropy"] = float(-(share * np.log2(share)).sum())
    for name, some in _KINDS.items():
        out[name] = float(of_byte[list(some)].sum()) / n
    full = [x for x in lines if x.strip()]
    out["repeated_lines"] = 1 - len(set(full)) / len(full) if full else 0.0
    if words:
        k = len(words)
        length = np.fromiter(map(len, words), np.int64, k)
        counts = Counter(words)
        out["log_words"] = math.log1p(k)
        out["mean_word"], out["spread_word"] = float(length.mean()), float(length.std())
        out["longest_word"] = math.log1p(int(length.max()))
        out["distinct_words"] = len(counts) / k
        out["distinct_pairs"] = len(set(zip(words, words[1:], strict=False))) / max(1, k - 1)
        out["top_word"] = max(counts.values()) / k
        out["shouted"] = sum(c for w, c in counts.items() if w.isupper() and len(w) > 1) / k
        out["no_letters"] = sum(c for w, c in counts.items() if not any(b >= 128 or chr(b).isalpha() for b in w)) / k
    return [out[s] for s in STATISTICS]


@dataclass
class Kernel:
    """Standardisation of the statistics and the random directions."""

    mean: np.ndarray
    spread: np.ndarray
    directions: np.ndarray
    phases: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """One row of cosines, and a one, for each row of statistics."""
        # Beyond six spreads a value says no more, and one odd document can't leave all others alike.
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        cosines = np.sqrt(2 / self.phases.size) * np.cos(z @ self.directions + self.phases)
        return np.c_[cosines, np.ones(len(x))]


def make_kernel(moments: np.ndarray | None, features: int, width: float, seed: int) -> Kernel:
    dim = len(STATISTICS)
    maker = np.random.default_rng(seed)
    directions = maker.normal(0, 1 / width, (dim, features))
    phases = maker.uniform(0, 2 * np.pi, features)
    if moments is None:
        return Kernel(np.zeros(dim), np.ones(dim), directions, phases)
    n, total, squares = moments[0], moments[1 : dim + 1], moments[dim + 1 :]
    mean = total / n
    spread = np.sqrt(np.maximum(squares / n - mean**2, 0))
    return Kernel(mean, np.where(spread > 1e-9, spread, 1.0), directions, phases)


def _added(parts: Sequence[bytes]) -> bytes:
    return np.sum([np.frombuffer(p) for p in parts], axis=0).tobytes()


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list()) if len(column) else np.zeros((0, len(STATISTICS)))


def _moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held = np.zeros(2 * len(STATISTICS) + 1)
    for pdf in batches:
        x = _matrix(pdf["statistics"])
        held += np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)])
    if held[0]:
        yield pd.DataFrame({"part": [held.tobytes()]})


@dataclass
class Quality:
    """A kernel, ridge weights on it, and the calibrated value of each step between ``low`` and ``high``."""

    kernel: Kernel
    weights: np.ndarray
    low: float
    high: float
    levels: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.kernel(x) @ self.weights

    def step(self, raw: np.ndarray) -> np.ndarray:
        at = (raw - self.low) / (self.high - self.low) * self.levels.size
        return np.clip(at.astype(np.int64), 0, self.levels.size - 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.levels[self.step(self.raw(x))]


def fit(
    learn: DataFrame,
    features: int = FEATURES,
    width: float = WIDTH,
    ridge: float = RIDGE,
    steps: int = STEPS,
    seed: int = 9,
) -> Quality | None:
    """From all rows of ``learn (statistics, label)``; None if there are none.

    The driver meets one matrix of ``(features + 2)**2`` sums and ``steps`` counts.
    """
    context = learn.sparkSession.sparkContext
    moments = tree_sum(learn.mapInPandas(_moments, "part binary"), _added)
    if moments is None:
        return None
    kernel = make_kernel(np.frombuffer(moments), features, width, seed)
    shared = context.broadcast(kernel)

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = shared.value.phases.size + 2
        held = np.zeros((size, size))
        for pdf in batches:
            z = np.c_[shared.value(_matrix(pdf["statistics"])), pdf["label"].to_numpy(dtype=float)]
            held += z.T @ z
        if held[-2, -2]:
            yield pd.DataFrame({"part": [held.tobytes()]})

    found = tree_sum(learn.mapInPandas(products, "part binary"), _added)
    sums = np.frombuffer(found).reshape(features + 2, features + 2)
    penalty = ridge * np.eye(features + 1)
    penalty[-1, -1] = 1e-9
    weights = np.linalg.solve(sums[:-1, :-1] + penalty, sums[:-1, -1])
    model = Quality(kernel, weights, -0.5, 1.5, np.zeros(steps))
    whole = context.broadcast(model)

    @F.pandas_udf("int")
    def step(x: pd.Series) -> pd.Series:
        return pd.Series(whole.value.step(whole.value.raw(_matrix(x))), dtype="int32")

    counts = learn.groupBy(step("statistics").alias("step")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("good")
    )
    got = counts.toArrow().to_pandas().sort_values("step")
    levels = pool_adjacent((got["good"] / got["n"]).to_numpy(dtype=float), got["n"].to_numpy(dtype=float))
    # Steps without a learned row lie between their neighbours.
    model.levels = np.interp(np.arange(steps), got["step"].to_numpy(), levels)
    return model


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    threshold: float = THRESHOLD,
    **options: float,
) -> DataFrame:
    """``doc_id, score, predicted`` of every row of ``docs``, and ``statistics``.

    Only rows where ``learn`` holds teach. Empty and null texts have statistics of 0 and the score
    of these. Without any label all scores are 0.5. Repeated rows and null ids stay.
    Statistics are of whole texts and are computed once, then stored.
    """

    @F.pandas_udf("array<double>")
    def describe(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t) for t in texts])

    teaches = F.lit(True) if learn is None else learn
    described = cut(
        docs.select(
            F.col(doc_id).alias("doc_id"), teaches.alias("teaches"), describe(text).alias("statistics")
        )
    )
    known = one_label(labels, label, doc_id)
    taught = cut(described.where("teaches").join(known, "doc_id").select("statistics", "label"))
    model = fit(taught, **options)
    if model is None:
        scored = described.withColumn("score", F.lit(0.5))
    else:
        shared = docs.sparkSession.sparkContext.broadcast(model)

        @F.pandas_udf("double")
        def judge(x: pd.Series) -> pd.Series:
            return pd.Series(shared.value.score(_matrix(x)))

        scored = described.withColumn("score", judge("statistics"))
    return scored.select(
        "doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "statistics"
    )


@query("op9_kernel_quality")
def op9_kernel_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    held_out = crc_share(F.col("doc_id"), 4) == 2
    scored = score_quality(docs, table(spark, sf_dir, "labels"), learn=~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")
