from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from geotext.llm import kernel_quality
from geotext.llm.common import table, tree_sum
from geotext.llm.kernel_quality import STATISTICS, _added, make_kernel, score_quality, statistics

SF = "/root/testdata/sf0.01"


def test_statistics():
    got = dict(zip(STATISTICS, statistics("AB ab!! 12\nAB ab!! 12\n\ncd | é"), strict=True))
    assert got["repeated_lines"] == pytest.approx(1 / 3)
    assert got["pipes"] == pytest.approx(1 / 30) and got["exclamations"] == pytest.approx(4 / 30)
    assert got["distinct_words"] == pytest.approx(6 / 9)
    assert got["no_letters"] == pytest.approx(3 / 9) and got["shouted"] == pytest.approx(2 / 9)
    for t in ("", None):
        assert statistics(t) == [0.0] * len(STATISTICS)
    for t in (" ", "\n", "é", "\x00", "x" * 200_000):
        assert np.isfinite(statistics(t)).all()


def test_features_stand_for_a_gaussian_kernel():
    kernel = make_kernel(None, 20_000, 4.0, 1)
    x = np.random.default_rng(2).normal(0, 1, (6, len(STATISTICS)))
    z = kernel(x)[:, :-1]
    far = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    assert np.abs(z @ z.T - np.exp(-far / (2 * 16))).max() < 0.05


def test_tree_sum(spark):
    rows = spark.range(0, 100, 1, 40).select(F.lit(np.array([1.0, 2.0]).tobytes()).alias("part"))
    assert np.frombuffer(tree_sum(rows, _added)).tolist() == [100, 200]
    assert tree_sum(rows.where(F.lit(False)), _added) is None


def test_edges(spark):
    maker = random.Random(3)
    word = lambda: maker.choice(["one", "two", "three", "four"])
    rows = [(i, " ".join(word().upper() + "!!" if i % 2 else word() for _ in range(30)), i % 2) for i in range(300)]
    rows += [(900, None, 0), (901, "", 0), (902, "word " * 50_000, 0), (902, "one two", 0), (None, "one two", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int")
    labels = docs.where("doc_id < 300").select("doc_id", (1 - F.col("label")).alias("quality"))
    labels = labels.unionByName(spark.createDataFrame([(None, 1), (3, None), (4, 1)], "doc_id long, quality int"))
    got = score_quality(docs, labels).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    for r in got:
        if r.doc_id is not None and r.doc_id < 300:
            assert r.predicted == 1 - r.doc_id % 2
    assert {r.score for r in score_quality(docs, labels.where(F.lit(False))).collect()} == {0.5}
    assert score_quality(docs.where(F.lit(False)), labels).count() == 0


def test_held_out_accuracy(spark):
    quality = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    got = kernel_quality.op9_kernel_quality(spark, SF).collect()
    assert len(got) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [(r.predicted, quality[r.doc_id]) for r in got if r.held_out and r.doc_id in quality]
    assert sum(p == y for p, y in held) >= 0.93 * len(held)
