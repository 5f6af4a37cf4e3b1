"""Cutting a lineage where a plan would grow with each round, or where row numbers must not be given twice."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the one the session names; a temporary one only where all run in this process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A new path in shared_dir(), deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in scratch(); the shuffle files of the query that makes it are deleted when it is written."""
    spark, name = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old, path = spark.conf.get(name, None), scratch(df.sparkSession)
    spark.conf.set(name, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(name) if old is None else spark.conf.set(name, old)
    return spark.read.schema(df.schema).parquet(path)


def settled(df: DataFrame) -> DataFrame:
    """df as a reliable checkpoint in shared_dir()."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)
