"""Tables in the folder that driver and executors share: ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset (tests on one machine) a local temporary folder is
    made, and remembered in the session.
    """
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if there is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        there = "file://" + tempfile.mkdtemp(prefix="lingualoom-")
        spark.sparkContext.setCheckpointDir(there)
    return there


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lingualoom/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to a new table in the shared folder and read it back: cuts the
    lineage, and a lost executor costs no recomputation of what was written."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows out evenly if they lie in fewer splits than there are cores: one
    large file, or a file of one row group. A table of many splits stays as it is, and
    so does what comes out of a shuffle (to ask for its splits would run it)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df._jdf.queryExecution().executedPlan().getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return df
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def forget(df: DataFrame) -> None:
    """Remove a table of :func:`written` that nothing will read again."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._shared_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
