"""Queries over text posts: ``documents`` stands for the posts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from geotext.catalog.inputs import table
from geotext.catalog.registry import query
from geotext.functions.text import char_bigrams, tokenize
from geotext.operators.ordered import collect_chunks
from geotext.operators.rows import counts, ungroup
from geotext.plans import text as plans
from geotext.session import at_least_cores, checkpoint_dir, cut
from geotext.sources.posts import to_json_rows
from geotext.streaming.posts import collect_stream, stream_classify, stream_to_table

TOKENS_SQL = """
tokens AS (
  SELECT doc_id, lang, CASE WHEN text = '' THEN [''] WHEN rtrim(text, ' ') = '' THEN []
    ELSE string_split(lower(rtrim(text, ' ')), ' ') END AS tokens FROM documents)"""

CHUNK = 25


def _documents(spark, sf):
    """The documents; their one file holds one row group, so one task would read and parse it all."""
    return at_least_cores(table(spark, sf, "documents"))


def _tokens(spark, sf):
    return _documents(spark, sf).select("doc_id", "lang", tokenize("text").alias("tokens"))


@query(
    "lang_counts",
    "SELECT lang, count(*) AS cnt FROM documents GROUP BY lang",
)
def lang_counts_query(spark, sf):
    return plans.lang_counts(table(spark, sf, "documents"))


@query(
    "num_languages",
    """SELECT count(DISTINCT lang) + coalesce(max(CAST(lang IS NULL AS INTEGER)), 0) AS num_languages
    FROM documents""",
)
def num_languages_query(spark, sf):
    return plans.num_languages(table(spark, sf, "documents"))


@query(
    "sample_posts",
    "SELECT lang, source, text FROM documents ORDER BY doc_id LIMIT 10",
)
def sample_posts_query(spark, sf):
    return plans.sample_posts(table(spark, sf, "documents"), ["lang", "source", "text"], "doc_id")


@query(
    "project_text_lang",
    "SELECT text, lang FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL",
)
def project_text_lang_query(spark, sf):
    return plans.project_text_lang(table(spark, sf, "documents"))


@query(
    "tokenize",
    f"""WITH {TOKENS_SQL}
    SELECT doc_id, CAST(len(tokens) AS INTEGER) AS n, array_to_string(tokens, '|') AS tokens FROM tokens""",
)
def tokenize_query(spark, sf):
    return _tokens(spark, sf).select(
        "doc_id", F.size("tokens").alias("n"), F.array_join("tokens", "|").alias("tokens")
    )


@query(
    "char_bigrams",
    """SELECT bigram, count(*) AS n FROM (
      SELECT unnest(list_transform(generate_series(1, len(c) - 1), lambda i: c[i] || c[i + 1])) AS bigram
      FROM (SELECT string_split(lower(text), '') AS c FROM documents))
    GROUP BY bigram""",
)
def char_bigrams_query(spark, sf):
    bigrams = _documents(spark, sf).select(F.explode(char_bigrams("text")).alias("bigram"))
    return counts(bigrams, "bigram")


@query(
    "counts",
    f"""WITH {TOKENS_SQL}
    SELECT token, count(*) AS n FROM (SELECT unnest(tokens) AS token FROM tokens) GROUP BY token""",
)
def counts_query(spark, sf):
    return counts(ungroup(_tokens(spark, sf), [], "tokens", "token"), "token")


@query(
    "ungroup",
    f"WITH {TOKENS_SQL} SELECT doc_id, unnest(tokens) AS token FROM tokens",
)
def ungroup_query(spark, sf):
    return ungroup(_tokens(spark, sf), ["doc_id"], "tokens", "token")


def _chunked(df, key):
    chunks = collect_chunks(df, [key], F.col("doc_id"), ["doc_id"], chunk_rows=CHUNK)
    return chunks.select(key, "chunk", F.array_join("items", ",").alias("doc_ids"))


def _chunked_sql(key: str, expression: str) -> str:
    return f"""SELECT {key}, CAST(pos // {CHUNK} AS BIGINT) AS chunk,
      string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS doc_ids
    FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY doc_id) - 1 AS pos
      FROM (SELECT doc_id, {expression} AS {key} FROM documents))
    GROUP BY ALL"""


@query("group_by_key", _chunked_sql("lang", "lang"))
def group_by_key_query(spark, sf):
    """Document ids per language, in arrays of bounded length."""
    return _chunked(table(spark, sf, "documents").select("lang", "doc_id"), "lang")


@query("group_collect", _chunked_sql("size_class", "n_chars // 1000"))
def group_collect_query(spark, sf):
    """Document ids per derived key, in arrays of bounded length."""
    size_class = F.floor(F.col("n_chars") / 1000).alias("size_class")
    return _chunked(table(spark, sf, "documents").select(size_class, "doc_id"), "size_class")


@query("hashed_term_counts")
def hashed_term_counts_query(spark, sf):
    return plans.hashed_term_counts(_tokens(spark, sf))


@query(
    "hashed_term_totals",
    f"""WITH {TOKENS_SQL} SELECT doc_id, CAST(len(tokens) AS BIGINT) AS terms FROM tokens
    WHERE len(tokens) > 0""",
)
def hashed_term_totals_query(spark, sf):
    """Terms per document over all buckets: hashing must lose none."""
    hashed = plans.hashed_term_counts(_tokens(spark, sf))
    return hashed.groupBy("doc_id").agg(F.sum("tf").alias("terms"))


def _trained(spark, sf):
    documents = _documents(spark, sf).select("doc_id", "text", "lang")
    return plans.train_text_kmeans(documents), documents


@query("text_kmeans_train")
def text_kmeans_train_query(spark, sf):
    model, documents = _trained(spark, sf)
    return plans.classify(model, documents).select("doc_id", "lang", "prediction")


@query("filter_cluster")
def filter_cluster_query(spark, sf):
    model, documents = _trained(spark, sf)
    return plans.filter_cluster(model, documents, 0).select("doc_id", "lang", "prediction")


@query("cluster_lang_counts")
def cluster_lang_counts_query(spark, sf):
    model, documents = _trained(spark, sf)
    return plans.cluster_lang_counts(plans.classify(model, documents), plans.model_k(model))


@query(
    "cluster_lang_totals",
    "SELECT lang, count(*) AS n FROM documents GROUP BY lang",
)
def cluster_lang_totals_query(spark, sf):
    """Summed over clusters, the language counts are those of the documents."""
    by_cluster = cluster_lang_counts_query(spark, sf).where(F.col("lang").isNotNull())
    return by_cluster.groupBy("lang").agg(F.sum("n").alias("n"))


@query("cluster_quality")
def cluster_quality_query(spark, sf):
    return plans.cluster_quality(cluster_lang_counts_query(spark, sf))


@query(
    "cluster_lang_agrees",
    "SELECT lang, count(*) AS n, true AS agrees, 0 AS wrong FROM documents WHERE text IS NOT NULL GROUP BY lang",
)
def cluster_lang_agrees_query(spark, sf):
    """Counts, ranks, shares and purity of the fitted clusters, each worked out another way, per language."""
    model, documents = _trained(spark, sf)
    labels = cut(plans.classify(model, documents).select("doc_id", "lang", "prediction"))
    made = plans.cluster_quality(plans.cluster_lang_counts(labels, plans.model_k(model)))
    labels.createOrReplaceTempView(view := f"labels_{uuid.uuid4().hex}")
    own = spark.sql(
        f"""WITH c AS (SELECT prediction, lang, count(*) AS n FROM {view} GROUP BY prediction, lang),
        s AS (SELECT prediction, count(*) AS size FROM {view} GROUP BY prediction),
        b AS (SELECT prediction, max(n) AS best FROM c GROUP BY prediction)
        SELECT c.prediction AS p, c.lang AS l, n AS own_n, n / size AS own_share, best / size AS own_purity,
          (SELECT count(*) FROM c d WHERE d.prediction = c.prediction AND (d.n > c.n OR d.n = c.n AND d.lang < c.lang)) AS above
        FROM c JOIN s ON s.prediction = c.prediction JOIN b ON b.prediction = c.prediction"""
    )
    both = made.join(own, (F.col("prediction") == F.col("p")) & F.col("lang").eqNullSafe(F.col("l")), "full")
    same = (
        (F.col("n") == F.col("own_n"))
        & (F.col("share") == F.col("own_share"))
        & (F.col("purity") == F.col("own_purity"))
        & (F.col("rank") == F.col("above") + 1)
    )
    wrong = F.count_if(~F.coalesce(same, F.lit(False)))
    by_lang = both.groupBy(F.coalesce("lang", "l").alias("lang"))
    return by_lang.agg(F.sum("n").alias("n"), (wrong == 0).alias("agrees"), wrong.cast("int").alias("wrong"))


@query(
    "filter_cluster_agrees",
    "SELECT doc_id, true AS kept_in_one, true AS as_classified FROM documents",
)
def filter_cluster_agrees_query(spark, sf):
    """Every document is kept by the filter of the cluster that it is classified to, and by no other."""
    model, documents = _trained(spark, sf)
    whole = plans.classify(model, documents).select("doc_id", "prediction")
    kept = plans.filter_cluster(model, documents, 0).select("doc_id", F.lit(0).alias("cluster"))
    for k in range(1, plans.model_k(model)):
        kept = kept.unionByName(
            plans.filter_cluster(model, documents, k).select("doc_id", F.lit(k).alias("cluster"))
        )
    both = whole.join(kept, "doc_id", "left").groupBy("doc_id", "prediction")
    return both.agg(F.count("cluster").alias("n"), F.max("cluster").alias("cluster")).select(
        "doc_id",
        (F.col("n") == 1).alias("kept_in_one"),
        (F.col("cluster") == F.col("prediction")).alias("as_classified"),
    )


@query(
    "stream_classify_agrees",
    "SELECT doc_id, true AS agrees FROM documents",
)
def stream_classify_agrees_query(spark, sf):
    """A stream keeps exactly the documents of the cluster that a batch keeps."""
    model, documents = _trained(spark, sf)
    path = _folder(spark, "agreed")
    kept = stream_classify(model, _stream(spark, sf).select("doc_id", "text", "lang"), 0)
    stream_to_table(kept.select("doc_id"), path, _folder(spark, "state"), interval=None).awaitTermination()
    streamed = spark.read.schema("doc_id long").parquet(path).withColumn("streamed", F.lit(True))
    whole = plans.classify(model, documents).select("doc_id", "prediction").join(streamed, "doc_id", "left")
    agrees = (F.col("prediction") == 0) == F.coalesce("streamed", F.lit(False))
    return whole.select("doc_id", agrees.alias("agrees"))


@query(
    "to_json_rows",
    """SELECT CAST(json_object('conv_id', conv_id, 'turn', turn, 'role', role, 'text', text) AS VARCHAR) AS value
    FROM conversations""",
)
def to_json_rows_query(spark, sf):
    return to_json_rows(table(spark, sf, "conversations"))


@query(
    "json_round_trip",
    "SELECT conv_id, turn, role, text FROM conversations",
)
def json_round_trip_query(spark, sf):
    """Conversations as JSON rows, parsed back."""
    conversations = table(spark, sf, "conversations")
    rows = to_json_rows(conversations)
    return rows.select(F.from_json("value", conversations.schema).alias("r")).select("r.*")


def _stream(spark, sf):
    """``documents`` as a file stream; the glob leaves the other tables of the folder out."""
    schema = table(spark, sf, "documents").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/docu*")


def _folder(spark, name):
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "collect_stream",
    "SELECT doc_id, lang, text FROM documents",
)
def collect_stream_query(spark, sf):
    """All documents taken from a stream into JSON files, read back."""
    root = _folder(spark, "collected")
    source = _stream(spark, sf).select("doc_id", "lang", "text")
    collect_stream(source, root, _folder(spark, "state"), limit=2**62, interval=None).wait()
    return spark.read.schema(source.schema).json(root).select(source.columns)


@query(
    "micro_batch",
    "SELECT lang, count(*) AS n FROM documents GROUP BY lang",
)
def micro_batch_query(spark, sf):
    path = _folder(spark, "batches")
    stream_to_table(
        _stream(spark, sf).select("doc_id", "lang"), path, _folder(spark, "state"), interval=None
    ).awaitTermination()
    return counts(spark.read.parquet(path), "lang")


@query("stream_classify")
def stream_classify_query(spark, sf):
    model, _ = _trained(spark, sf)
    path = _folder(spark, "classified")
    kept = stream_classify(model, _stream(spark, sf).select("doc_id", "text", "lang"), 0)
    stream_to_table(
        kept.select("doc_id", "lang", "prediction"), path, _folder(spark, "state"), interval=None
    ).awaitTermination()
    return spark.read.parquet(path)
