"""From raw documents to packed training sequences, a stage at a time.

``STAGES`` are (name, function) pairs. A function takes the session, the documents that its predecessor
kept and the folder of the tables, and returns the documents that stay; the last one
returns where each piece of them lies in the training sequences.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from geotext.catalog.registry import query
from geotext.llm.chunk_recipes import drop_copies
from geotext.llm.common import crc_share, short_batches, table
from geotext.llm.kneser_ney import drop_toxic
from geotext.llm.popcount_simhash import drop_near_copies
from geotext.llm.two_fit import pack_documents
from geotext.llm.window_search import drop_contaminated
from geotext.session import checkpoint_dir, configure

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go. The rows held out by their id do not teach."""
    configure(spark)
    with short_batches(spark):
        return drop_toxic(docs, table(spark, sf_dir, "labels"), learn=crc_share(F.col("doc_id"), 3) != 1)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal but for white space the one with the smallest id stays."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by their fingerprints the one with the smallest id stays."""
    with short_batches(spark):
        return drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, each with its place in a sequence."""
    with short_batches(spark):
        return pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("packing", packing),
]

#: Models, fingerprints and tokens are beyond SQL; the tests hold each stage against a brute version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Each result but the last is written to the shared folder and read again."""
    configure(spark)
    folder = f"{checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs


@query("pipeline", ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir)
