"""Places and tables that driver and all executors share."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The session's checkpoint folder; where none is set, a temporary one on a single machine, an error on a cluster."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-larder-"))
    return sc.getCheckpointDir().rstrip("/")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below it; the file system removes it when the application ends."""
    folder = f"{shared_root(spark)}/larder-{uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return folder


def settled(rows: DataFrame) -> DataFrame:
    """Rows computed once, written to the shared folder and read back: every use sees the same values, a lost executor
    costs no recomputation, and the sizes that Spark plans with are those of the files."""
    folder = f"{shared_folder(rows.sparkSession)}/rows"
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)
