"""Sessions, and the package's own code on executors."""

from __future__ import annotations

import hashlib
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str = "local[*]", partitions: int | None = None, **more: str) -> SparkSession:
    builder = SparkSession.builder.master(master).appName("tidewell").config(map=SETTINGS | more)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give the workers this package, once per Spark context, whatever folder they run in."""
    context = spark.sparkContext
    if getattr(context, "_tidewell_shipped", False):
        return
    top = Path(__file__).parent
    files = sorted(p for p in top.rglob("*.py"))
    digest = hashlib.md5(b"".join(p.read_bytes() for p in files)).hexdigest()[:12]
    folder = tempfile.mkdtemp(prefix="tidewell-")
    archive = os.path.join(folder, f"tidewell_{digest}.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in files:
            z.write(p, p.relative_to(top.parent))
    context.addPyFile(archive)
    context._tidewell_shipped = True


#: File bytes per core up to which a table of few files is dealt to all cores.
SPREAD_BYTES = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table of fewer files than cores, dealt to all cores: a row group is one task's, and texts are costly to analyse.

    Larger tables, and those of many files, stay as they are, unshuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= cores * SPREAD_BYTES and len(df.inputFiles()) < cores else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share.  One of this machine does only for a local master."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "tidewell-checkpoints"))
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """df written to the shared folder, which cuts its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
