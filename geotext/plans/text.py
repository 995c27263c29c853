"""Text clustering: profile posts by language, train k-means on hashed counts, inspect it."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import HashingTF, NGram, RegexTokenizer
from pyspark.sql import DataFrame, Window, functions as F

from geotext.functions.text import hashed_counts
from geotext.session import at_least_cores, cut

NUM_FEATURES = 10_000
ROUNDS = 20


def lang_counts(posts: DataFrame, lang: str = "lang") -> DataFrame:
    """Posts per language, most frequent first; NULL is a group."""
    return posts.groupBy(F.col(lang).alias("lang")).agg(F.count(F.lit(1)).alias("cnt")).orderBy(
        F.desc("cnt"), "lang"
    )


def num_languages(posts: DataFrame, lang: str = "lang", count_null: bool = True) -> DataFrame:
    """How many language groups there are, NULL included unless told otherwise."""
    n = F.count_distinct(lang)
    if count_null:
        n = n + F.coalesce(F.max(F.col(lang).isNull().cast("int")), F.lit(0))
    return posts.agg(n.alias("num_languages"))


def sample_posts(posts: DataFrame, columns: list[str], order: str, n: int = 10) -> DataFrame:
    """The first n posts by key."""
    return posts.orderBy(order).limit(n).select(*columns)


def project_text_lang(posts: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Text and language of the posts that have both."""
    chosen = posts.select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    return chosen.where(F.col("text").isNotNull() & F.col("lang").isNotNull())


def hashed_term_counts(
    documents: DataFrame, num_features: int = NUM_FEATURES, id: str = "doc_id", tokens: str = "tokens"
) -> DataFrame:
    """``(id, bucket, tf)``; counted within each document's row, so nothing is shuffled."""
    return documents.select(id, F.inline(hashed_counts(tokens, num_features)))


def text_pipeline(
    k: int, num_features: int = NUM_FEATURES, rounds: int = ROUNDS, seed: int = 13, features: str = "word"
) -> Pipeline:
    """Tokenizer, hashed counts and k-means as one unit, saved and loaded together.

    ``features`` is ``"word"`` or ``"char_bigram"``.
    """
    if features == "word":
        stages = [
            RegexTokenizer(
                inputCol="text", outputCol="tokens", pattern=" ", gaps=True, toLowercase=True,
                minTokenLength=0,
            )
        ]
    elif features == "char_bigram":
        stages = [
            RegexTokenizer(
                inputCol="text", outputCol="characters", pattern=r"(?s).", gaps=False,
                toLowercase=True,
            ),
            NGram(n=2, inputCol="characters", outputCol="tokens"),
        ]
    else:
        raise ValueError(f"unknown features {features!r}")
    return Pipeline(
        stages=[
            *stages,
            HashingTF(inputCol="tokens", outputCol="features", numFeatures=num_features),
            KMeans(k=k, maxIter=rounds, seed=seed, featuresCol="features"),
        ]
    )


def train_text_kmeans(
    posts: DataFrame, k: int | None = None, count_null: bool = False, **options
) -> PipelineModel:
    """Fit the pipeline on posts with a text and a language; k defaults to the languages' number.

    The fit reads the features for its size, its start and its summary besides its rounds: they are worked out once and stored.
    """
    if k is None:
        k = num_languages(posts, count_null=count_null).first()[0]
    # Every round of the fit reads the features: a small table should use all cores.
    *helpers, kmeans = text_pipeline(k, **options).getStages()
    featured = PipelineModel(helpers).transform(at_least_cores(project_text_lang(posts)))
    return PipelineModel([*helpers, kmeans.fit(cut(featured.select(kmeans.getFeaturesCol())))])


def model_k(model: PipelineModel) -> int:
    return len(model.stages[-1].clusterCenters())


def classify(model: PipelineModel, posts: DataFrame) -> DataFrame:
    """Posts with their cluster in ``prediction``; works on a stream too."""
    helpers = [c for s in model.stages[:-1] for c in (s.getOutputCol(),)]
    return model.transform(posts).drop(*helpers)


def filter_cluster(model: PipelineModel, posts: DataFrame, cluster: int) -> DataFrame:
    """The posts of one cluster."""
    return classify(model, posts).where(F.col("prediction") == cluster)


def cluster_lang_counts(predicted: DataFrame, k: int, lang: str = "lang") -> DataFrame:
    """Posts per cluster and language; a cluster without posts is listed with no language and 0."""
    sizes = predicted.groupBy("prediction", F.col(lang).alias("lang")).agg(
        F.count(F.lit(1)).alias("n")
    )
    clusters = predicted.sparkSession.range(k).select(F.col("id").cast("int").alias("prediction"))
    return clusters.join(sizes, "prediction", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def cluster_quality(lang_sizes: DataFrame) -> DataFrame:
    """Per cluster: languages by falling frequency, with rank, share, and the cluster's purity.

    Works on the counts, so a window holds one row per language.
    """
    cluster = Window.partitionBy("prediction")
    ranked = Window.partitionBy("prediction").orderBy(F.desc("n"), "lang")
    size = F.sum("n").over(cluster)
    return lang_sizes.where(F.col("n") > 0).select(
        "prediction",
        "lang",
        "n",
        F.row_number().over(ranked).alias("rank"),
        (F.col("n") / size).alias("share"),
        (F.max("n").over(cluster) / size).alias("purity"),
    )


def silhouette(model: PipelineModel, posts: DataFrame) -> float:
    """Mean silhouette over the hashed counts."""
    return ClusteringEvaluator(featuresCol="features").evaluate(model.transform(posts))
