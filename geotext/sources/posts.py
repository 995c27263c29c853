"""Reading posts: geo posts and text posts as JSON lines, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

GEO_SCHEMA = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in (
            "post_id",
            "user_id",
            "tweet_latitude",
            "tweet_longitude",
            "user_city_latitude",
            "user_city_longitude",
        )
    ]
)
TEXT_SCHEMA = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField(
            "user",
            T.StructType(
                [T.StructField("lang", T.StringType()), T.StructField("name", T.StringType())]
            ),
        ),
    ]
)

GEO_COLUMNS = {  # ours -> (field of the source, type)
    "user_id": ("user_id", "bigint"),
    "post_id": ("post_id", "bigint"),
    "lat": ("tweet_latitude", "double"),
    "lon": ("tweet_longitude", "double"),
    "home_lat": ("user_city_latitude", "double"),
    "home_lon": ("user_city_longitude", "double"),
}


def read_geo(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Geo posts as they are stored: every field a string. One read feeds points and homes."""
    return spark.read.schema(GEO_SCHEMA).json(path)


def cast_geo(raw: DataFrame, strict: bool = True) -> DataFrame:
    """Typed geo posts. ``strict`` fails on a value that is no number or missing.

    Otherwise such rows are dropped; ``count_rejects`` tells how many.
    """
    if strict:
        return raw.select(
            *[_required(source, kind).alias(name) for name, (source, kind) in GEO_COLUMNS.items()]
        )
    typed = _lenient(raw)
    return typed.where(~_rejected())


def count_rejects(raw: DataFrame) -> DataFrame:
    """One row: how many posts a lenient ``cast_geo`` drops."""
    return _lenient(raw).agg(F.count_if(_rejected()).alias("rejected"))


def _required(source: str, kind: str):
    missing = F.raise_error(F.lit(f"{source} is missing")).cast("string")
    return F.coalesce(F.col(source), missing).cast(kind)


def _lenient(raw: DataFrame) -> DataFrame:
    return raw.select(
        *[F.col(source).try_cast(kind).alias(name) for name, (source, kind) in GEO_COLUMNS.items()]
    )


def _rejected():
    bad = F.lit(False)
    for name in GEO_COLUMNS:
        bad = bad | F.col(name).isNull()
    return bad


def points_of(posts: DataFrame) -> DataFrame:
    return posts.select("user_id", "post_id", "lat", "lon")


def read_text(spark: SparkSession, path: str | list[str], infer: bool = False) -> DataFrame:
    """Text posts from a folder, a glob of folders, or a root of ``batch_id=`` folders."""
    reader = spark.read if infer else spark.read.schema(TEXT_SCHEMA)
    return reader.json(path)


def stream_text(
    spark: SparkSession, path: str, schema: T.StructType = TEXT_SCHEMA, files_per_batch: int = 1000
) -> DataFrame:
    """Text posts as a stream over JSON files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def register_view(df: DataFrame, name: str) -> DataFrame:
    """Name a table for SQL."""
    df.createOrReplaceTempView(name)
    return df


def to_json_rows(df: DataFrame) -> DataFrame:
    """Each record as one JSON string in ``value``."""
    return df.select(F.to_json(F.struct("*")).alias("value"))
