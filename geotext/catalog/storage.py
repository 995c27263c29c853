"""Queries over the sources and sinks: derived posts are written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from geotext.catalog.geo import _as_stored
from geotext.catalog.inputs import POSTS_SQL, TRUTH_SQL, points, posts, table
from geotext.catalog.registry import query
from geotext.plans import homes
from geotext.plans import text as plans
from geotext.session import checkpoint_dir
from geotext.sources import posts as sources
from geotext.sources import tables
from geotext.streaming.posts import stream_to_table

POSTS = "SELECT text, lang, CAST(doc_id AS VARCHAR) AS name FROM documents"


def folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _stored_geo(spark: SparkSession, sf: str) -> str:
    path = folder(spark, "geo-posts")
    _as_stored(posts(spark, sf)).write.json(path)
    return path


def _stored_text(spark: SparkSession, sf: str) -> str:
    """Documents as text posts, in one folder for even ids and one for odd ones."""
    root = folder(spark, "text-posts")
    user = F.struct("lang", F.col("doc_id").cast("string").alias("name")).alias("user")
    rows = table(spark, sf, "documents").select("text", user, (F.col("doc_id") % 2).alias("batch_id"))
    rows.write.partitionBy("batch_id").json(root)
    return root


def _flat(read: DataFrame) -> DataFrame:
    return read.select("text", "user.lang", "user.name")


@query("scan_posts_geo", f"WITH {POSTS_SQL} SELECT user_id, post_id, lat, lon FROM posts")
def scan_posts_geo_query(spark, sf):
    raw = sources.read_geo(spark, _stored_geo(spark, sf))
    return sources.points_of(sources.cast_geo(raw))


@query("scan_author_geo", f"WITH {POSTS_SQL}, {TRUTH_SQL} SELECT * FROM truth")
def scan_author_geo_query(spark, sf):
    return homes.author_truth(sources.cast_geo(sources.read_geo(spark, _stored_geo(spark, sf))))


@query("scan_posts_text", POSTS)
def scan_posts_text_query(spark, sf):
    return _flat(sources.read_text(spark, f"{_stored_text(spark, sf)}/batch_id=*"))


@query("scan_posts_text_root", POSTS.replace(" FROM", ", CAST(doc_id % 2 AS INTEGER) AS batch_id FROM"))
def scan_posts_text_root_query(spark, sf):
    """The root of the folders; the folder's number is a column to filter by."""
    read = sources.read_text(spark, _stored_text(spark, sf))
    return read.select("text", "user.lang", "user.name", F.col("batch_id").cast("int").alias("batch_id"))


@query("register_view", "SELECT lang, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS letters FROM documents GROUP BY lang")
def register_view_query(spark, sf):
    name = f"posts_{uuid.uuid4().hex}"
    sources.register_view(sources.read_text(spark, _stored_text(spark, sf)), name)
    return spark.sql(f"SELECT user.lang, count(*) AS n, sum(length(text)) AS letters FROM {name} GROUP BY user.lang")


@query("stream_posts", POSTS)
def stream_posts_query(spark, sf):
    stream = sources.stream_text(spark, f"{_stored_text(spark, sf)}/batch_id=*", files_per_batch=1)
    path = folder(spark, "streamed")
    stream_to_table(_flat(stream), path, folder(spark, "state"), interval=None).awaitTermination()
    return spark.read.parquet(path)


@query("save_load_table", "SELECT doc_id, lang, n_chars FROM documents")
def save_load_table_query(spark, sf):
    path = folder(spark, "table")
    tables.save_table(table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), path, ["lang"])
    return tables.load_table(spark, path).select("doc_id", "lang", "n_chars")


@query("reuse_or_compute", f"WITH {POSTS_SQL} SELECT user_id, post_id, lat, lon FROM posts")
def reuse_or_compute_query(spark, sf):
    """Computed and saved at first, taken from the folder after that."""
    path = folder(spark, "reused")
    tables.reuse_or_compute(spark, path, lambda: points(spark, sf), reuse=True)
    return tables.reuse_or_compute(spark, path, lambda: points(spark, sf).limit(0), reuse=True)


@query("reuse_without_marker", f"WITH {POSTS_SQL} SELECT user_id, post_id, lat, lon FROM posts")
def reuse_without_marker_query(spark, sf):
    """A folder whose write did not finish is computed again."""
    path = folder(spark, "unfinished")
    points(spark, sf).limit(0).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    return tables.reuse_or_compute(spark, path, lambda: points(spark, sf), reuse=True)


@query("save_load_model", "SELECT doc_id, lang, true AS agrees FROM documents")
def save_load_model_query(spark, sf):
    """A fitted model, saved and loaded, must name the same cluster for every document."""
    documents = table(spark, sf, "documents").select("doc_id", "text", "lang")
    model, path = plans.train_text_kmeans(documents, num_features=1000, rounds=3), folder(spark, "model")
    tables.save_model(model, path)
    first = plans.classify(model, documents).select("doc_id", "lang", "prediction")
    again = plans.classify(tables.load_model(path), documents).select("doc_id", F.col("prediction").alias("loaded"))
    return first.join(again, "doc_id").select("doc_id", "lang", (F.col("prediction") == F.col("loaded")).alias("agrees"))


@query(
    "write_grid_report",
    """SELECT round(user_id % 4 / 10.0, 1) AS eps, CAST(event_id % 3 AS INTEGER) AS m, count(*) AS score
    FROM events GROUP BY ALL""",
)
def write_grid_report_query(spark, sf):
    """Scores per configuration as one CSV file, read back."""
    eps = F.round(F.col("user_id") % 4 / 10.0, 1).alias("eps")
    scores = table(spark, sf, "events").groupBy(eps, (F.col("event_id") % 3).cast("int").alias("m"))
    path = folder(spark, "report")
    tables.write_grid_report(scores.agg(F.count(F.lit(1)).alias("score")), path)
    return spark.read.schema("eps double, m int, score long").option("header", True).csv(path)


@query("cache_table", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def cache_table_query(spark, sf):
    kept = tables.cache_table(table(spark, sf, "documents").select("lang"))
    out = spark.createDataFrame(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect(), "lang string, n long")
    kept.unpersist()
    return out
