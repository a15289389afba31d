"""What every operator needs from the session: the shared folder and tables that cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Only in local mode, where neither the setting nor the context has one, is a
    temporary folder made and set; a cluster must name its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    made = "file://" + tempfile.mkdtemp(prefix="lodespark-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below this application's part of the shared folder."""
    return f"{_own(spark)}/{name}-{uuid.uuid4().hex}"


def _own(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/lodespark/{spark.sparkContext.applicationId}"


RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back.

    The result depends on replicated files only, so a lost executor never
    sends Spark back through the plan that made them. release: the plan's
    shuffle files are deleted at once, not when the driver next collects garbage.
    """
    spark = df.sparkSession
    path, before = scratch_path(spark, name), spark.conf.get(RELEASE)
    try:
        if release:
            spark.conf.set(RELEASE, "true")
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(RELEASE, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Deletes every table that `written` left in this application's part of the shared folder."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_own(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def package_on_workers(spark: SparkSession) -> None:
    """Lets Python workers import this package when it isn't installed on them."""
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in have:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, have)])
