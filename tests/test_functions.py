from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from geotext.functions import distance as dist
from geotext.functions import text

# The tokens each text must give.
TOKENS = {
    "a  B c ": ["a", "", "b", "c"],
    "": [""],
    "   ": [],
    " x": ["", "x"],
    "tab\there": ["tab\there"],
    "ünï Çé": ["ünï", "çé"],
}
# Buckets of 10,000.
BUCKETS = {
    "a": 3170,
    "abc": 7556,
    "abcd": 7100,
    "hello": 5048,
    "ünï": 8415,
    "": 3372,
    "spark": 3105,
    "bonjour": 1593,
}


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_distances(spark):
    points = [F.lit(v) for v in (36.12, -86.67, 33.94, -118.40)]
    assert one(spark, dist.haversine_km(*points)) == pytest.approx(2887.2599506071106, abs=1e-9)
    assert one(spark, dist.degrees_to_km(F.lit(1.0))) == pytest.approx(111.22634257109463, abs=1e-10)
    square = [F.lit(float(v)) for v in (0, 0, 3, 4)]
    assert one(spark, dist.euclidean(*square)) == 5.0
    assert one(spark, dist.manhattan(*square)) == 7.0
    antipodes = [F.lit(v) for v in (0.0, 0.0, 0.0, 180.0)]
    assert one(spark, dist.haversine_km(*antipodes)) == pytest.approx(math.pi * 6372.8)


def test_array_distances_agree_with_numpy(spark):
    rng = np.random.default_rng(1)
    for name, d in dist.DISTANCES.items():
        a, b = rng.normal(size=(2, 2))
        x, y = (F.array(*[F.lit(float(v)) for v in p]) for p in (a, b))
        assert one(spark, d.on_arrays(x, y)) == pytest.approx(d.on_rows(a[None, :], b)[0]), name
    zero = F.array(F.lit(0.0), F.lit(0.0))
    assert math.isnan(one(spark, dist.array_cosine(zero, F.array(F.lit(1.0), F.lit(1.0)))))
    with pytest.raises(PySparkException, match="needs"):
        one(spark, dist.array_haversine(F.array(F.lit(0.0)), zero))
    with pytest.raises(ValueError, match="unknown distance"):
        dist.distance("chess")


def test_tokens(spark):
    df = spark.createDataFrame([(t,) for t in TOKENS], "t string")
    for r in df.select("t", text.tokenize("t").alias("k")).collect():
        assert r["k"] == TOKENS[r["t"]]


def test_hashed_counts(spark):
    words = ["a", "abc", "a", "", "bonjour", "a"]
    df = spark.createDataFrame([(words,), ([],), (list(BUCKETS),)], "k array<string>")
    got = [
        {c["bucket"]: c["tf"] for c in r["c"]}
        for r in df.select(text.hashed_counts("k", 10_000).alias("c")).collect()
    ]
    assert got == [
        dict(Counter(BUCKETS[w] for w in words)),
        {},
        dict.fromkeys(BUCKETS.values(), 1),
    ]


def test_char_bigrams(spark):
    df = spark.createDataFrame([("Abca",), ("x",), ("",), ("éßü",)], "t string")
    got = [r["b"] for r in df.select(text.char_bigrams("t").alias("b")).collect()]
    assert got == [["ab", "bc", "ca"], [], [], ["éß", "ßü"]]
