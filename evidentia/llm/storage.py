"""Row identities and intermediate tables that survive the loss of executors.

Everything that a later step reads twice is written once as Parquet below the
folder that the cluster names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread

#: Identity of an input row: a hash of its file's path, and its place in that file.
ROW_ID = ("__file", "__row")

#: Bytes of one Arrow batch sent to a Python worker.
BATCH_BYTES = 8 << 20

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share; one of our own only in local mode, where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if context.applicationId not in _own_folders:
        _own_folders[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="evidentia-")
    return _own_folders[context.applicationId]


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends at the latest."""
    path = f"{shared_folder(spark)}/evidentia-{label}-{uuid.uuid4().hex}"
    files, target = _file_system(spark, path)
    files.deleteOnExit(target)
    return path


def saved(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as a shared Parquet table and read again. The shuffles that made it are removed with the write."""
    spark = df.sparkSession
    path = new_path(spark, label)
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._saved_at = path
    return table


def dropped(*tables: DataFrame | None) -> None:
    """Delete tables of ``saved`` whose last reader has ended."""
    for table in tables:
        if table is not None:
            files, target = _file_system(table.sparkSession, table._saved_at)
            files.delete(target, True)


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that very long texts do not pile up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def with_row_ids(docs: DataFrame) -> DataFrame:
    """``docs`` with ``ROW_ID``, the same on each read; a frame that isn't a file scan is saved first."""
    names = [c for c in docs.columns if c not in ROW_ID]

    def tagged(df: DataFrame) -> DataFrame:
        return spread(
            df.select(
                *[F.col(f"`{c}`") for c in names],
                F.xxhash64("_metadata.file_path").alias(ROW_ID[0]),
                F.col("_metadata.row_index").alias(ROW_ID[1]),
            )
        )

    bounded_batches(docs.sparkSession)
    if "_metadata" in docs._jdf.queryExecution().analyzed().metadataOutput().mkString(" "):
        return tagged(docs)
    return tagged(saved(docs.select(*[F.col(f"`{c}`") for c in names]), "rows"))


def most_frequent(totals: DataFrame, count: str, most: int) -> DataFrame:
    """The rows of a saved table with the greatest counts: as many whole levels of 1/16 of an octave as ``most`` rows take.

    Only the sizes of the levels, a thousand at most, are gathered; no task sorts
    or holds the candidates of all others.
    """
    level = F.floor(F.log2(count) * 16)
    left, lowest = most, None
    for row in totals.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("level")).collect():
        if row["n"] > left:
            break
        left, lowest = left - row["n"], row["level"]
    return totals.where(level >= lowest) if lowest is not None else totals.limit(0)
