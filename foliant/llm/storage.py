"""Tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    """This application's folder in ``spark.checkpoint.dir``; its tables may go when the application has ended.

    Only on one machine (a ``local`` master) is an unset folder replaced by a temporary one;
    on a cluster that is an error, since executors could not read each other's files.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        master = context.master.split("[")[0]
        if master != "local":
            raise ValueError(f"spark.checkpoint.dir is not set, and executors of {context.master} share no other folder")
        folder = f"file://{tempfile.gettempdir()}/foliant"
    return f"{folder.rstrip('/')}/foliant-{context.applicationId}"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back, so that a lost executor repeats nothing before it."""
    spark: SparkSession = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    void = {c: F.col(c).cast("string") for c, kind in df.dtypes if kind == "void"}  # Parquet has no such type
    (df.withColumns(void) if void else df).write.parquet(path)
    found = spark.read.parquet(path)
    found._written = path
    return found


def release(*frames: DataFrame) -> None:
    """Deletes tables of ``checkpointed`` that nothing reads any more; other frames are left alone."""
    for df in frames:
        path = getattr(df, "_written", None)
        if path:
            gateway = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            gateway.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(gateway, True)
