from __future__ import annotations

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from geotext.operators import ordered, rows
from geotext.operators.skew import attach

SEQUENCES = {"xD": ["x"], "Dx": ["", "x"], "xDDy": ["x", "", "y"], "xDD": ["x"], "D": []}


def skewed(spark):
    """Two thirds of the rows in one group, one group NULL."""
    rng = random.Random(1)
    pairs = [(rng.choice([1, 1, 1, 1, 2, 3, None]), i) for i in range(300)]
    return pairs, spark.createDataFrame(pairs, "g int, i int")


@pytest.mark.parametrize("limits", ["usual", "tiny"])
def test_positions_and_running_totals(spark, request, limits):
    if limits == "tiny":
        request.getfixturevalue("tiny_limits")
    pairs, df = skewed(spark)
    got = {
        (r["g"], r["i"]): (r["n"], r["s"])
        for r in ordered.running_totals(
            df.repartition(5), {"n": F.lit(1), "s": F.col("i")}, ["i"], ["g"], blocks=6
        ).collect()
    }
    seen = {}
    for g, i in sorted(pairs, key=lambda p: p[1]):
        n, s = seen.get(g, (0, 0))
        seen[g] = (n + 1, s + i)
        assert got[(g, i)] == seen[g]
    numbered = ordered.with_position(df.drop("g"), ["i"], blocks=4).collect()
    assert all(r["position"] == r["i"] + 1 for r in numbered)


def test_split_at(spark):
    _, df = skewed(spark)
    first = ordered.split_at(df, 10, ["i"]).where("part = 0").collect()
    assert sorted(r["i"] for r in first) == list(range(10))
    per_group = ordered.split_at(df, 2, ["i"], ["g"]).where("part = 0").groupBy("g").count().collect()
    assert {r["count"] for r in per_group} == {2}


def test_split_keeps_leading_and_inner_empty_segments_only(spark):
    data = [(s, i, c) for s in SEQUENCES for i, c in enumerate(s)]
    df = spark.createDataFrame(data, "s string, i int, c string")
    segments = ordered.split_on(df, "c", "D", ["i"], ["s"])
    sizes = ordered.segment_sizes(segments, ["s"]).collect()
    for s, want in SEQUENCES.items():
        got = sorted((r["segment"], r["n"]) for r in sizes if r["s"] == s)
        assert got == [(k, len(w)) for k, w in enumerate(want)], s
    assert ordered.split_on(df.limit(0), "c", "D", ["i"], ["s"]).count() == 0


def test_drop_right_while(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1, 2, 3, 4, 6])], "i int, v int")
    even = F.col("v") % 2 == 0
    assert [r["v"] for r in ordered.drop_right_while(df, even, "i").orderBy("i").collect()] == [1, 2, 3]
    assert ordered.drop_right_while(df.where(even), even, "i").count() == 0


def test_zip_safe(spark):
    a = spark.createDataFrame([(3,), (1,), (2,)], "a int")
    b = spark.createDataFrame([("x",), ("z",), ("y",)], "b string")
    zipped = ordered.zip_safe(a, b, ["a"], ["b"]).collect()
    assert {(r["a"], r["b"]) for r in zipped} == {(1, "x"), (2, "y"), (3, "z")}
    with pytest.raises(PySparkException, match="differ in length"):
        ordered.zip_safe(a, b.limit(2), ["a"], ["b"]).collect()
    arrays = spark.range(1).select(F.array(F.lit(1)).alias("x"), F.array(F.lit(1), F.lit(2)).alias("y"))
    with pytest.raises(PySparkException, match="differ in length"):
        arrays.select(ordered.zip_arrays(F.col("x"), F.col("y"))).collect()


def test_collect_chunks_is_whole_and_bounded(spark):
    pairs, df = skewed(spark)
    chunks = ordered.collect_chunks(df, ["g"], F.col("i"), ["i"], chunk_rows=16).collect()
    assert max(len(r["items"]) for r in chunks) == 16
    for g in {g for g, _ in pairs}:
        mine = sorted((r["chunk"], r["items"]) for r in chunks if r["g"] == g)
        assert [i for _, items in mine for i in items] == [i for h, i in pairs if h == g]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_attach_is_a_join_whatever_the_skew(spark, tiny_limits, how):
    pairs, df = skewed(spark)
    names = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "g int, name string")
    for null_safe in (False, True):
        got = attach(df, names, ["g"], how, null_safe=null_safe).collect()
        known = {1: "a", 2: "b", **({None: "n"} if null_safe else {})}
        want = [(g, i, known.get(g)) for g, i in pairs if how == "left" or g in known]
        assert sorted((r["i"], r["g"], r["name"]) for r in got) == sorted(
            ((i, g, n) for g, i, n in want), key=lambda t: t[0]
        )


def test_normalize(spark, tiny_limits):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", 0)], "g string, v int")
    shares = rows.normalize(df, "v", "s").orderBy("g", "v").collect()
    assert [r["s"] for r in shares] == [0.25, 0.25, 0.5, 0.0]
    grouped = rows.normalize(df, "v", "s", ["g"]).orderBy("g", "v").collect()
    assert [r["s"] for r in grouped] == [0.25, 0.25, 0.5, None]


def test_row_operators(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("b", 5)], "key string, value int")
    assert [r["n"] for r in rows.map_to(df, "value", lambda v: v * 2, "n").collect()] == [2, 4, 10]
    assert {r["v"] for r in rows.map_to_value(df, 7, "v").collect()} == {7}
    assert {r["key"] for r in rows.map_keys(df, F.upper).collect()} == {"A", "B"}
    assert [r["value"] for r in rows.map_values(df, lambda v: -v).collect()] == [-1, -2, -5]
    both = rows.map_columns(df, ["key", "value"], lambda k, v: F.concat(k, v.cast("string")), "kv")
    assert [r["kv"] for r in both.collect()] == ["a1", "b2", "b5"]
    assert {(r["key"], r["n"]) for r in rows.counts(df, "key").collect()} == {("a", 1), ("b", 2)}
    assert rows.average(df.limit(0), "value").first()["avg"] is None
    arrays = spark.createDataFrame([("a", [1, 2]), ("b", [])], "k string, vs array<int>")
    assert {(r["k"], r["v"]) for r in rows.ungroup(arrays, ["k"], "vs", "v").collect()} == {("a", 1), ("a", 2)}
    order = [r["value"] for r in rows.shuffle_rows(df, "value", 3).collect()]
    assert order == [r["value"] for r in rows.shuffle_rows(df.repartition(3), "value", 3).collect()]
