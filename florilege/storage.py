"""Intermediate results as Parquet in the shared folder that the session names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders written by this process and not yet removed.
_WRITTEN: list[str] = []


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; a private one only where none is set and Spark runs on one machine."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not spark.sparkContext.master.split("[")[0] == "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="florilege-")
        spark.sparkContext.setCheckpointDir(folder)
    return jsc.getCheckpointDir().get()


def _path(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back, so that a lost executor costs no recomputation.

    Readers prune columns and know sizes. What was written is removed when the application ends, or by ``release``.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, where = _path(spark, path)
    fs.deleteOnExit(where)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Remove every intermediate result written so far; results that still depend on them can't be read afterwards."""
    n = len(_WRITTEN)
    while _WRITTEN:
        fs, where = _path(spark, _WRITTEN.pop())
        fs.delete(where, True)
    return n
