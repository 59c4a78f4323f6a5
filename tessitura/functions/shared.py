"""The folder that the driver and all executors share, and the number of tasks that dear rows are dealt over."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A path that no other call gets, under spark.checkpoint.dir; under a local folder only where that is unset on one machine."""
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    folder = found.get() if found.isDefined() else spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame, kind: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, however often it is read, and kept when executors are lost."""
    folder = shared_folder(df.sparkSession, kind)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def spread(spark: SparkSession) -> int:
    """Tasks for work that is dear by row and small by bytes, which sizes of files would put into one: several for each core."""
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
