"""Token-ID output (operator 8): Parquet list columns.

Files in ascending doc_id order, one row per document:

``part`` (number of the file's task), ``place`` (row in it), ``doc_id``,
``part_start`` (ids before it in its file), ``n_tokens``, ``tokens``
(list of ids).

The token list is dictionary-encoded, so a page holds bit-packed indexes into
the ids its row group uses; the other columns ascend or vary little and are
delta-encoded. Row groups and pages are kept small and each column chunk has a
column index and an offset index, so a reader of some doc_ids skips whole pages
of tokens, and a reader of the metadata columns never touches the token pages.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, shuffle_parts, stage_path
from .tokens import default_vocabulary, encoder

ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 2_000
_SCHEMA = "part int, place long, doc_id long, part_start long, n_tokens long, tokens array<int>"
_META = ["part", "place", "doc_id", "part_start", "n_tokens"]


def _tokenize(vocabulary: str, added_tokens: bool, end_id: int):
    def run(batches):
        encode, part = encoder(vocabulary, added_tokens), TaskContext.get().partitionId()
        end, place, start = np.array([end_id], "<u4").tobytes(), 0, 0
        for batch in batches:
            ids = [encode.ids(t.as_py() or "") + end for t in batch.column("text")]
            if not ids:
                continue
            sizes = np.array([len(x) // 4 for x in ids], np.int64)
            before = start + np.cumsum(sizes) - sizes
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<i4")))
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(place, place + n)), batch.column("doc_id"),
                 pa.array(before), pa.array(sizes), tokens], names=[*_META, "tokens"])
            place, start = place + n, start + int(sizes.sum())
    return run


def write_tokens(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", end_id: int = 0,
                 vocabulary: str | None = None, added_tokens: bool = False) -> None:
    """Encode whole texts, add ``end_id`` to each, and write the format above to ``path``.

    A null or empty text is its end id alone. Rows that repeat a doc_id are all
    written, ordered by text hash; null ids come first. ``doc_id`` must be an
    integer column. An empty table writes files without rows.
    ``added_tokens``: see :class:`.tokens.Encoder`.
    """
    bounded_batches(docs.sparkSession)
    rows = (docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
            .withColumn("tie", F.xxhash64("text"))
            .repartitionByRange(shuffle_parts(docs.sparkSession), "doc_id", "tie")
            .sortWithinPartitions("doc_id", "tie").select("doc_id", "text"))
    writer = rows.mapInArrow(_tokenize(vocabulary or default_vocabulary(), added_tokens, end_id), _SCHEMA).write.mode("errorifexists")
    options = {"parquet.block.size": ROW_GROUP_BYTES, "parquet.page.size": PAGE_BYTES, "parquet.page.row.count.limit": PAGE_ROWS,
               "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false",
               "parquet.enable.dictionary#tokens.list.element": "true", "parquet.dictionary.page.size": 1 << 20, "compression": "zstd"}
    writer.options(**options).parquet(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """All but the tokens; only the metadata columns are read."""
    return spark.read.schema(_SCHEMA).parquet(path).select(_META)


def read_tokens(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """Rows of the documents with low <= doc_id <= high (open where None); page indexes skip the rest."""
    rows = spark.read.schema(_SCHEMA).parquet(path)
    if low is not None:
        rows = rows.where(F.col("doc_id") >= low)
    return rows if high is None else rows.where(F.col("doc_id") <= high)


def part_starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, base): ids in all files before a part's. One row per file."""
    sizes = read_metadata(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()  # one row per file
    rows, base = [], 0
    for r in sorted(sizes):
        rows.append((r["part"], base))
        base += r["n"]
    return spark.createDataFrame(rows, "part int, base long")


def _crc32(lists: pa.Array) -> pa.Array:
    values = memoryview(np.ascontiguousarray(lists.values.to_numpy(), "<u4")).cast("B")
    at = lists.offsets.to_numpy().astype(np.int64) * 4
    return pa.array([zlib.crc32(values[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.int64())


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) read back from the files.

    ``start``: ids of all documents before it; ``ids_crc32``: unsigned crc32 of
    the ids as little-endian unsigned 32-bit integers.
    """
    crc = F.arrow_udf(_crc32, "long")
    return (read_tokens(spark, path).join(F.broadcast(part_starts(spark, path)), "part")
            .select("doc_id", (F.col("base") + F.col("part_start")).alias("start"), "n_tokens", crc("tokens").alias("ids_crc32")))


def write_to_stage(docs: DataFrame, **kw) -> str:
    """:func:`write_tokens` into a new folder of the shared checkpoint folder; returns its path."""
    path = stage_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, **kw)
    return path
