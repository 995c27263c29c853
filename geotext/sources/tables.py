"""Saving and reusing intermediate tables, models and reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

REUSE_LEVELS = ("none", "locations", "predictions", "all")


def save_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write a table, replacing what was there, and read it back."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.parquet(path)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a finished write is there: the marker of its commit, not just the folder."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)


def reuse_or_compute(
    spark: SparkSession, path: str, compute: Callable[[], DataFrame], reuse: bool
) -> DataFrame:
    """The saved table if it may be used and is complete; else compute and save it."""
    if reuse and is_complete(spark, path):
        return load_table(spark, path)
    return save_table(compute(), path)


def may_reuse(level: str, table: str) -> bool:
    """Whether ``level`` lets a table of the kind ``locations`` or ``predictions`` be reused."""
    if level not in REUSE_LEVELS:
        raise ValueError(f"unknown reuse level {level!r}; known: {REUSE_LEVELS}")
    return level == "all" or level == table or (level, table) == ("predictions", "locations")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def write_grid_report(scores: DataFrame, path: str) -> None:
    """The scores of a grid search as one CSV file: one row per configuration."""
    scores.orderBy("eps", "m").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def cache_table(df: DataFrame, eager: bool = True) -> DataFrame:
    """Keep a table that is read more than once; ``eager`` fills it now."""
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    if eager:
        df.count()
    return df
