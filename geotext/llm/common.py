"""What the document operators share: reading tables, held-out rows, and sharing small values."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from geotext.catalog.registry import query
from geotext.session import checkpoint_dir, configure, cut

__all__ = ["Buckets", "configure", "crc_share", "cut", "forget", "placed", "query", "short_batches", "short_shuffles", "sigmoid_of", "stored", "table", "tree_sum"]


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A stored table, read through Spark alone, with only the columns asked for."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*(columns or ["*"]))


def crc_share(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts


def sigmoid_of(column: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-column))


def stored(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as a table in the shared folder and go on from it: a narrow table takes a third of a checkpoint.

    The table stays there until ``forget`` or the user clears it.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _hadoop_path(spark: SparkSession, folder: str) -> tuple[Any, Any]:
    path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI.create(folder))
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def forget(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` wrote, once all that reads them is stored in its turn."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if not folder.rsplit("/", 1)[-1].startswith("stored-"):
                raise ValueError(f"not a table of this library: {folder}")
            path, files = _hadoop_path(df.sparkSession, folder)
            files.delete(path, True)


class Buckets:
    """A table dealt to ``n`` buckets by ``key`` as it is written, so that joins by the key need not move it again.

    Its files are in the shared folder, its name in the session's catalog, both until ``drop``.
    """

    def __init__(self, spark: SparkSession, key: str, n: int):
        self.spark, self.key, self.n = spark, key, n
        self.name = f"geotext_{uuid.uuid4().hex}"
        self.path = f"{checkpoint_dir(spark)}/stored-{self.name}"

    def add(self, df: DataFrame) -> None:
        dealt = df.repartition(self.n, self.key).write.bucketBy(self.n, self.key)
        dealt.mode("append").option("path", self.path).saveAsTable(self.name, format="parquet")

    @property
    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE {self.name}")
        path, files = _hadoop_path(self.spark, self.path)
        files.delete(path, True)


@contextmanager
def short_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of frames made inside go as soon as what ran is done, not when the driver collects its garbage.

    For frames that are run once: what runs again must work its shuffles out again.
    """
    with _set(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        yield


#: Bytes of rows that a worker is handed at once.
BATCH_BYTES = 4 << 20


@contextmanager
def short_batches(spark: SparkSession) -> Iterator[None]:
    """Rows of frames run inside go to Python in batches of about ``BATCH_BYTES``, however long the texts are.

    By Spark's settings a batch is 10,000 rows or 64 MB, which executor and worker both hold, some of it several times over.
    """
    with _set(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES)):
        yield


@contextmanager
def _set(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Rows that one file may have; the number of the file fills the bits above.
FILE_ROWS = 1 << 40

#: Plans under which a row of a file stays one row.
_ONE_TO_ONE = {"LogicalRelation", "Relation", "Project", "Filter", "SubqueryAlias"}


def _plan_nodes(plan: Any) -> set[str]:
    children = plan.children()
    return {plan.nodeName().split()[0]}.union(*[_plan_nodes(children.apply(i)) for i in range(children.size())])


def placed(docs: DataFrame, tag: str = "row_tag") -> DataFrame:
    """``docs`` with ``tag``, a number of each row's own that every later scan gives it again.

    The number is the file's among the sorted names of the table's files, and the place of the row in
    it; neither depends on how a scan is split among tasks. What is not a plain scan of
    files, with columns and rows chosen, is first stored in the shared folder. ``docs`` may not have a column ``tag``.
    The names of the files, which planning the scan holds on the driver anyway, are broadcast.
    """
    spark = docs.sparkSession
    files = docs.inputFiles()
    plain = _plan_nodes(docs._jdf.queryExecution().analyzed()) <= _ONE_TO_ONE
    if not (files and plain) or "_metadata" in docs.columns:
        back = list(docs.columns)
        docs = stored(docs.toDF(*[f"c{i}" for i in range(len(back))]))
        files = docs.inputFiles()
    else:
        back = None
    # Without an authority the plan writes three slashes where a scan writes one.
    files = sorted({re.sub(r"^([^:/]+):///", r"\1:/", f) for f in files})
    names = spark.createDataFrame(list(enumerate(files)), "_number long, _file string")
    out = docs.withColumns({"_file": F.col("_metadata.file_path"), "_row": F.col("_metadata.row_index")})
    out = out.join(F.broadcast(names), "_file", "left")
    number = F.coalesce("_number", F.raise_error(F.concat(F.lit("a file that the plan did not name: "), "_file")).cast("long"))
    out = out.select(*docs.columns, (number * FILE_ROWS + F.col("_row")).alias(tag))
    return out.toDF(*back, tag) if back else out


def tree_sum(
    df: DataFrame, merge: Callable[[Sequence[bytes]], bytes], value: str = "part", fan_in: int = 16
) -> bytes | None:
    """Fold the packed partial sums in ``value`` to one, ``fan_in`` at a time, on the executors.

    ``df`` has one row per task, each of the same bounded size. Each level writes a
    ``fan_in``-th of the rows of the one before, and only the last row meets the driver.
    None for an empty table.
    """

    def fold(batches: Any) -> Any:
        import pandas as pd

        held: list[bytes] = []
        for pdf in batches:
            for part in pdf["part"]:
                held.append(bytes(part))
                if len(held) == fan_in:
                    held = [merge(held)]
        if held:
            yield pd.DataFrame({"part": [merge(held)]})

    parts = cut(df.select(F.col(value).alias("part")))
    n = parts.count()
    while n > 1:
        tasks = -(-n // fan_in)
        parts = cut(parts.repartition(tasks).mapInPandas(fold, "part binary"))
        n = parts.count()
    row = parts.first()
    return None if row is None else bytes(row["part"])
