"""Collecting a stream of posts into files, and filtering a stream to one cluster."""

from __future__ import annotations

import threading
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from geotext.plans.text import filter_cluster
from geotext.sources.posts import to_json_rows

DEFAULT_LIMIT = 10_000

#: Folder of the count records inside a sink; readers of the sink leave out names that begin so.
COUNTS = "_counts"


class LimitReached(Exception):
    """Raised in a batch that comes after the limit; the batch is not committed."""


@dataclass
class Collector:
    """A running collection; ``wait`` returns once the limit is passed or the stream ends."""

    limit: int
    total: int
    full: threading.Event = field(default_factory=threading.Event)
    query: StreamingQuery | None = None

    def wait(self, poll_seconds: float = 0.2) -> int:
        while self.query.isActive and not self.full.wait(poll_seconds):
            pass
        if self.query.isActive and self.full.is_set():
            self.query.stop()
        failure = self.query.exception()
        if failure is not None and LimitReached.__name__ not in str(failure):
            raise failure
        return self.total


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there, in any file system Spark reads."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)


def _count_records(spark: SparkSession, root: str) -> DataFrame | None:
    """``stream, batch_id, n`` of every batch in the sink: one small record each, posts are not read."""
    folder = f"{root}/{COUNTS}"
    if not _exists(spark, folder):
        return None
    return spark.read.schema("n long, stream string, batch_id long").json(folder)


def collected_total(spark: SparkSession, root: str) -> int:
    """Posts in the sink, of all streams that have written to it."""
    records = _count_records(spark, root)
    return 0 if records is None else records.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def collect_stream(
    posts: DataFrame,
    root: str,
    checkpoint: str,
    limit: int = DEFAULT_LIMIT,
    partitions: int | None = None,
    interval: str | None = "10 seconds",
) -> Collector:
    """Write each non-empty batch as JSON lines to ``root/stream=<id>/batch_id=<n>`` until over ``limit``.

    The stream's id lives in its checkpoint folder: a restart goes on in the same folder, and a collection
    with a new checkpoint gets a folder of its own, so none overwrites another. The
    limit holds for all of them together and is tested after a whole batch, so a collection ends
    with more than ``limit`` posts. A replayed batch overwrites its own folder and is counted once. A
    batch that starts after the limit is left uncommitted, so a restart with a higher limit takes
    it. ``interval=None`` processes what is there and ends. ``partitions`` gives each
    batch that many files; without it a batch keeps its own partitioning, however wide.
    """
    spark = posts.sparkSession
    collector = Collector(limit, collected_total(spark, root))
    if collector.total > limit:
        collector.full.set()
    started = threading.Event()
    written: set[int] = set()

    def write(batch: DataFrame, batch_id: int) -> None:
        started.wait()
        at = f"stream={collector.query.id}/batch_id={batch_id}"
        record = f"{root}/{COUNTS}/{at}"
        before = 0
        if not written and _exists(spark, record):  # the first batch of a run may be a replay
            before = spark.read.schema("n long").json(record).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if collector.full.is_set() and not before:
            raise LimitReached(f"more than {limit} posts collected")
        written.add(batch_id)
        if batch.isEmpty():
            return
        seen = Observation()
        rows = to_json_rows(batch).observe(seen, F.count(F.lit(1)).alias("n"))
        if partitions:
            rows = rows.repartition(partitions)
        rows.write.mode("overwrite").text(f"{root}/{at}")
        n = seen.get["n"]
        spark.range(1).select(F.lit(n).alias("n")).write.mode("overwrite").json(record)
        collector.total += n - before
        if collector.total > limit:
            collector.full.set()

    writer = posts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    collector.query = writer.trigger(**trigger).start()
    started.set()
    return collector


def stream_classify(model: PipelineModel, posts: DataFrame, cluster: int) -> DataFrame:
    """The posts of one cluster, as a stream."""
    return filter_cluster(model, posts, cluster)


def stream_to_table(
    posts: DataFrame, path: str, checkpoint: str, interval: str | None = "5 seconds"
) -> StreamingQuery:
    """Append a stream to a parquet table, in micro-batches or once over what is there."""
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return (
        posts.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def stream_print(posts: DataFrame, rows: int = 10, interval: str = "5 seconds") -> StreamingQuery:
    """Print the first rows of each batch."""
    return (
        posts.writeStream.format("console")
        .option("numRows", rows)
        .trigger(processingTime=interval)
        .start()
    )
