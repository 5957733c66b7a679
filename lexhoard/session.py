"""Session helpers shared by the jobs: table paths, written intermediate tables, and a local session for tests."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, shuffle_partitions: int = 8, memory: str = "6g") -> SparkSession:
    """A local session for tests and benchmarks. On a cluster the caller brings their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local session, whose executors are the driver, gets a
    temporary one where that is unset; on a cluster an unset folder is an error, as other machines would not see a local one."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-lexhoard-"))
        at = sc.getCheckpointDir()
    return at


def _hadoop_path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def saved(df: DataFrame) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back.

    Cuts the lineage like checkpoint(), survives the loss of executors, computes df once and keeps columns prunable.
    The files go when the session ends, or earlier by `discard`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexhoard-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    at, files = _hadoop_path(spark, path)
    files.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables that `saved` returned. No DataFrame that still reads them may be used afterwards."""
    for df in tables:
        at, files = _hadoop_path(df.sparkSession, df.saved_at)
        files.delete(at, True)
