"""The folder that driver and executors share, and tables written there."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the folder set by ``setCheckpointDir``. Local masters get a temporary one where neither is set."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if set_dir:
        return set_dir.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ferrule-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


#: Spark's setting that removes a query's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: later plans start there, and a lost executor costs no recomputation. Shuffle files of the write go with its end."""
    spark = df.sparkSession
    path, before = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}", spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    got = spark.read.schema(df.schema).parquet(path)
    got._path = path
    return got


def replaced(old: DataFrame, df: DataFrame) -> DataFrame:
    """A table in place of the one it was made from, which no later plan reads."""
    got, spark = written(df), df.sparkSession
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(old._path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    return got
