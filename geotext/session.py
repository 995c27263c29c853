"""Session settings the plans rely on, and the one way lineage is cut."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Lets a table already hashed by author serve joins and groupings on
    # (author, cell, ...) without another exchange.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning": "false",
}


def configure(spark: SparkSession) -> SparkSession:
    """Set the runtime options the plans are tuned for; results do not depend on them.

    Sends the package to the workers, once per application, so that they need no copy of their own.
    """
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    ship_package(spark)
    return spark


#: Of each application that has the package: the folder from which its driver serves it, as long as it lives.
_shipped: dict[str, tempfile.TemporaryDirectory] = {}


def ship_package(spark: SparkSession) -> None:
    """Add the package's modules as a zip file to those that workers import."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    folder = _shipped[context.applicationId] = tempfile.TemporaryDirectory(prefix="geotext-package-")
    root = Path(__file__).resolve().parent
    archive = Path(folder.name).resolve() / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as package:
        for module in sorted(root.rglob("*.py")):
            package.write(module, module.relative_to(root.parent))
    context.addPyFile(str(archive))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a local session without one gets a new folder."""
    context = spark.sparkContext
    folder = context.getCheckpointDir()
    if folder:
        return folder
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="geotext-checkpoint-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from the files, with no lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def at_least_cores(df: DataFrame) -> DataFrame:
    """Spread a table stored in fewer parts than there are cores; a larger one stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
