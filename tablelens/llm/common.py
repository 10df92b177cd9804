"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
SPACES = " \t\n\x0b\x0c\r"
#: Byte table that lower-cases A-Z and nothing else.
LOWER_BYTES = bytes(range(256)).translate(bytes.maketrans(UPPER.encode(), LOWER.encode()))
#: Rows in a batch to a Python worker, where the session has Spark's default.
BATCH_ROWS = 1000
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Stands for a null id wherever ids are compared as numbers: smaller than any id.
NO_ID = -(1 << 63)


def lower_ascii(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def stage_path(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, removed when the driver's JVM ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tablelens-{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def cut(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Lineage ends there, so a lost executor costs only the tasks it was running,
    and whatever is non-deterministic in ``df`` (row numbers) is fixed.
    """
    path = stage_path(df.sparkSession, name)
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stage(df: DataFrame) -> None:
    """Delete the files of a frame made by :func:`cut` that nothing will read again."""
    spark = df.sparkSession
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        if "/tablelens-" in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bounded_batches(spark: SparkSession) -> None:
    """Send fewer rows at once to Python workers: rows are whole texts here, and Spark's default of
    10,000 rows a batch can be gigabytes of long ones. A value the session's owner chose stays."""
    if spark.conf.get(_BATCH_SETTING) == "10000":
        spark.conf.set(_BATCH_SETTING, str(BATCH_ROWS))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``, is 0. A null id counts as the text ''."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % folds == 0
