"""The session's settings."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Times are UTC; Spark re-plans joins and partitions while it runs.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "evidentia", **more: str) -> SparkSession:
    """A session with ``SETTINGS``; further settings by keyword, dots written as double underscores."""
    builder = SparkSession.builder.appName(app)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in more.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Bytes for each core up to which an input in few files is dealt anew.
SPREAD_BYTES = 128 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores if it is a small scan of fewer files than cores: one row group is one task, whatever the plan says.

    Larger inputs, or those in many files, are left as they are and not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    files = df.inputFiles()
    if not 0 < len(files) < cores:
        return df
    size = df._jdf.queryExecution().analyzed().stats().sizeInBytes()
    return df.repartition(cores) if int(size) < cores * SPREAD_BYTES else df


#: Bytes of one batch that a Python worker gets at once.
BATCH_BYTES = 16 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small: rows of long texts and of blocks are megabytes each."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def saved(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table that all executors share, for frames that are read more than once; it goes when the driver ends."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``, which all executors share; a local one only in local mode without that setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.gettempdir()
    return f"{folder.rstrip('/')}/evidentia-{label}-{uuid.uuid4().hex}"
