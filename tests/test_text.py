from __future__ import annotations

import json
import time

import pytest
from pyspark.errors import PySparkException, StreamingQueryException
from pyspark.sql import functions as F

from geotext.plans import text
from geotext.sources import posts, tables
from geotext.streaming.posts import (
    collect_stream,
    collected_total,
    stream_classify,
    stream_print,
    stream_to_table,
)

TEXTS = [("the cat and the dog", "en"), ("le chat et le chien", "fr"), ("der hund und", "de")]


@pytest.fixture
def documents(spark):
    rows = [(i, *TEXTS[i % 3]) for i in range(30)] + [(98, "x", None), (99, None, "en")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_profile(documents):
    counted = [(r["lang"], r["cnt"]) for r in text.lang_counts(documents).collect()]
    assert counted == [("en", 11), ("de", 10), ("fr", 10), (None, 1)]
    assert text.num_languages(documents).first()[0] == 4
    assert text.num_languages(documents, count_null=False).first()[0] == 3
    assert text.project_text_lang(documents).count() == 30
    sample = text.sample_posts(documents, ["lang", "text"], "doc_id", 2).collect()
    assert [r["lang"] for r in sample] == ["en", "fr"]


@pytest.mark.parametrize("features", ["word", "char_bigram"])
def test_train_save_load_and_inspect(spark, documents, tmp_path, features):
    model = text.train_text_kmeans(documents, num_features=1000, features=features)
    path = str(tmp_path / "model")
    tables.save_model(model, path)
    tables.save_model(model, path)
    loaded = tables.load_model(path)
    kept = text.project_text_lang(documents)
    a, b = (text.classify(m, kept).collect() for m in (model, loaded))
    assert a == b and text.model_k(loaded) == 3
    sizes = text.cluster_lang_counts(text.classify(model, kept), 5)
    assert {r["prediction"] for r in sizes.collect()} == set(range(5))
    totals = sizes.where("n > 0").groupBy("lang").agg(F.sum("n").alias("n")).collect()
    assert {r["lang"]: r["n"] for r in totals} == {"en": 10, "fr": 10, "de": 10}
    quality = text.cluster_quality(sizes).collect()
    assert all(r["purity"] == 1.0 and r["rank"] == 1 for r in quality)
    assert text.silhouette(model, kept) == pytest.approx(1.0)


def test_pipeline_and_expression_tokens_agree(spark):
    from geotext.functions.text import tokenize

    df = spark.createDataFrame([("a  B c ",), ("",), ("   ",), (" x",), ("tab\there",)], "text string")
    stage = text.text_pipeline(2).getStages()[0]
    for r in stage.transform(df).withColumn("ours", tokenize("text")).collect():
        assert r["tokens"] == r["ours"]


def write_json(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(json.dumps(r) for r in rows))


GEO = {
    "post_id": "1", "user_id": "7", "tweet_latitude": "1.5", "tweet_longitude": "2.5",
    "user_city_latitude": "3", "user_city_longitude": "4",
}


def test_geo_source(spark, tmp_path):
    write_json(tmp_path / "geo.json", [GEO, {**GEO, "post_id": "2", "tweet_latitude": "north"}, {"post_id": "3"}])
    raw = posts.read_geo(spark, str(tmp_path / "geo.json"))
    typed = posts.cast_geo(raw, strict=False)
    assert [tuple(r) for r in typed.collect()] == [(7, 1, 1.5, 2.5, 3.0, 4.0)]
    assert posts.points_of(typed).columns == ["user_id", "post_id", "lat", "lon"]
    assert posts.count_rejects(raw).first()["rejected"] == 2
    for bad in (2, 3):
        with pytest.raises(PySparkException):
            posts.cast_geo(raw.where(f"post_id = {bad}")).collect()


def test_text_source_over_folders(spark, tmp_path):
    for batch in (1, 2):
        rows = [{"text": f"t{batch}", "user": {"lang": "en", "name": "n"}}]
        write_json(tmp_path / f"batch_id={batch}" / "part.json", rows)
    by_glob = posts.read_text(spark, str(tmp_path / "batch_id=*"))
    by_root = posts.read_text(spark, str(tmp_path)).where("batch_id = 2")
    assert by_glob.count() == 2 and by_root.first()["text"] == "t2"
    assert posts.read_text(spark, str(tmp_path), infer=True).select("user.lang").distinct().count() == 1
    posts.register_view(by_glob, "posts_view")
    assert spark.sql("SELECT user.name FROM posts_view").count() == 2


def test_tables_reuse_and_report(spark, tmp_path):
    calls = []

    def compute():
        calls.append(1)
        return spark.range(len(calls))

    path = str(tmp_path / "t")
    assert tables.reuse_or_compute(spark, path, compute, reuse=True).count() == 1
    assert tables.reuse_or_compute(spark, path, compute, reuse=True).count() == 1
    assert tables.reuse_or_compute(spark, path, compute, reuse=False).count() == 2
    (tmp_path / "t" / "_SUCCESS").unlink()
    assert tables.reuse_or_compute(spark, path, compute, reuse=True).count() == 3
    assert [tables.may_reuse(level, "locations") for level in tables.REUSE_LEVELS] == [False, True, True, True]
    assert [tables.may_reuse(level, "predictions") for level in tables.REUSE_LEVELS] == [False, False, True, True]
    scores = spark.createDataFrame([(0.2, 1, 0.5), (0.1, 3, 0.7)], "eps double, m int, score double")
    tables.write_grid_report(scores, str(tmp_path / "report"))
    saved = spark.read.option("header", True).csv(str(tmp_path / "report")).collect()
    assert [r["eps"] for r in saved] == ["0.1", "0.2"]
    cached = tables.cache_table(spark.range(3))
    assert cached.is_cached
    cached.unpersist()


@pytest.fixture
def stream_dir(spark, tmp_path):
    """Five files of ten posts each."""
    for n in range(5):
        rows = [{"text": TEXTS[i % 3][0], "user": {"lang": TEXTS[i % 3][1], "name": f"{n}-{i}"}} for i in range(10)]
        write_json(tmp_path / "in" / f"{n}.json", rows)
    return str(tmp_path / "in")


def test_collect_stops_over_the_limit_and_goes_on_after_a_restart(spark, tmp_path, stream_dir):
    root, state = str(tmp_path / "out"), str(tmp_path / "state")
    for limit, total in ((20, 30), (20, 30), (35, 40), (1000, 50)):
        stream = posts.stream_text(spark, stream_dir, files_per_batch=1)
        collector = collect_stream(stream, root, state, limit=limit, partitions=5, interval=None)
        assert collector.wait() == total
        assert collected_total(spark, root) == total
    saved = posts.read_text(spark, root)
    assert saved.select("user.name").distinct().count() == 50
    (stream,) = (tmp_path / "out").glob("stream=*")
    assert len(list((stream / "batch_id=0").glob("part-*"))) == 5


def test_a_new_checkpoint_adds_to_the_sink(spark, tmp_path, stream_dir):
    root = str(tmp_path / "out")
    first = posts.stream_text(spark, stream_dir, files_per_batch=1)
    assert collect_stream(first, root, str(tmp_path / "s1"), limit=20, interval=None).wait() == 30
    second = posts.stream_text(spark, stream_dir, files_per_batch=1)
    assert collect_stream(second, root, str(tmp_path / "s2"), limit=45, interval=None).wait() == 50
    assert posts.read_text(spark, root).count() == 50
    assert len(list((tmp_path / "out").glob("stream=*"))) == 2


def test_a_failure_is_raised_even_when_the_limit_is_reached(spark, tmp_path, stream_dir):
    boom = F.when(F.length("text") >= 0, F.raise_error(F.lit("boom"))).cast("string")
    bad = posts.stream_text(spark, stream_dir).withColumn("text", boom)
    collector = collect_stream(bad, str(tmp_path / "out"), str(tmp_path / "s"), limit=5, interval=None)
    while collector.query.isActive:
        time.sleep(0.1)
    collector.full.set()
    with pytest.raises(StreamingQueryException, match="boom"):
        collector.wait()


def test_stream_print(spark, stream_dir):
    query = stream_print(posts.stream_text(spark, stream_dir), rows=3, interval="1 second")
    try:
        query.processAllAvailable()
        assert sum(p["numInputRows"] for p in query.recentProgress) == 50
        assert query.exception() is None
    finally:
        query.stop()


def test_stream_classify_equals_batch(spark, tmp_path, stream_dir, documents):
    model = text.train_text_kmeans(documents, num_features=1000)
    source = posts.stream_text(spark, stream_dir, files_per_batch=2)
    path = str(tmp_path / "kept")
    kept = stream_classify(model, source, 1)
    stream_to_table(kept, path, str(tmp_path / "s"), interval=None).awaitTermination()
    batch = text.filter_cluster(model, posts.read_text(spark, stream_dir), 1)
    got = spark.read.parquet(path)
    assert 0 < got.count() == batch.count() < 50
    assert got.select("text").distinct().count() == 1


def test_a_fit_reads_each_text_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for pdf in batches:
            read.add(len(pdf))
            yield pdf

    rows = [(f"{'red green' if k % 2 else 'three four'} w{k % 7}", "en" if k % 2 else "fr") for k in range(40)]
    written = spark.createDataFrame(rows, "text string, lang string")
    model = text.train_text_kmeans(written.mapInPandas(seen, written.schema), k=2, num_features=64)
    assert read.value == len(rows)
    own = text.text_pipeline(2, num_features=64).fit(written)
    assert [c.tolist() for c in model.stages[-1].clusterCenters()] == [c.tolist() for c in own.stages[-1].clusterCenters()]
    assert text.model_k(model) == 2 and text.classify(model, written).count() == len(rows)
