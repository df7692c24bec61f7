"""Spark session defaults and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Session settings that matter for the plans in this package.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "quire") -> SparkSession:
    """Build (or reuse) a session. On a cluster pass master=None and let
    spark-submit decide; locally default to local[*]."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("QUIRE_DRIVER_MEMORY", "8g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names in
    ``spark.checkpoint.dir``. Where it is unset, a run on one machine gets a
    fresh scratch folder; on a cluster, executors would each write to their own
    disk, so that is an error."""
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return conf_dir
    if sc.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="quire-ckpt-", dir="/tmp")
    sc.setCheckpointDir(local)
    return local


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/quire-tables/{name}-{uuid.uuid4().hex}"


#: Spark's setting by which a query's shuffle files go when it ends.
SHUFFLES_REMOVED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files. Otherwise they stay until the driver happens to collect its
    garbage, and those of all earlier writes lie on the disks together."""
    before = spark.conf.get(SHUFFLES_REMOVED, None)
    if before == "true":
        yield
        return
    spark.conf.set(SHUFFLES_REMOVED, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLES_REMOVED) if before is None else spark.conf.set(SHUFFLES_REMOVED, before)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder that ``shared_folder`` named."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def write_table(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as a parquet table under the shared checkpoint folder and
    read it back: lineage is cut, and readers keep column pruning, filter
    pushdown and file statistics (unlike an RDD checkpoint)."""
    path = path or shared_folder(df.sparkSession, name)
    with shuffles_removed(df.sparkSession):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)
