"""Session settings and durable intermediate results."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

PARTITION_BYTES = 4 << 20  # of Parquet files; joins and windows over them hold some thirty times as much
TASK_BYTES = 8 << 20  # of shuffled data; a sort or hash table over them holds some twenty times as much


def build_session(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume; `conf` overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession, folder: str | None = None) -> SparkSession:
    """Pin the session time zone: naive timestamps mean UTC everywhere here. With the folder of the input, shuffles get a
    partition per PARTITION_BYTES of it (never fewer than the session has), so that what one task holds does not grow with
    the input; adaptive execution merges those that are small, up to TASK_BYTES."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    if folder:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        size = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
        have = int(spark.conf.get("spark.sql.shuffle.partitions"))
        spark.conf.set("spark.sql.shuffle.partitions", str(max(have, -(-size // PARTITION_BYTES))))
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(TASK_BYTES))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and tables that must outlive an executor.

    The cluster names it in `spark.checkpoint.dir`, or the program by `setCheckpointDir`. Where neither is done, a
    folder of our own is taken in local mode only: on a cluster no machine sees another's.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        path = tempfile.mkdtemp(prefix="spark-tidemark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, for a result read more than once."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def reachable(df: DataFrame) -> DataFrame:
    """Puts this package on the path of Python workers that share the driver's machine. On a cluster the package is
    installed or sent with the job (`--py-files`), as any other."""
    paths = df.sparkSession.sparkContext.environment
    if ROOT not in paths.get("PYTHONPATH", "").split(os.pathsep):
        paths["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, paths.get("PYTHONPATH")]))
    return df
