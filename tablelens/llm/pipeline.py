"""The stages of the corpus pipeline: thin calls of the operators.

Every stage takes ``(spark, docs, sf_dir)``. All but the last return the columns
of ``docs``. Null texts pass every filter; an empty table passes as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import contaminated, find_contamination
from .line_dedup import dedup_lines
from .packing import pack_documents
from .simhash import simhash_dedup
from .toxicity import classify_toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clean_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    judged = classify_toxicity(docs, _table(spark, sf_dir, "labels"))
    return judged.where("predicted = 0").select("doc.*")


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the lines that many documents share; ``n_chars`` follows. No document goes."""
    out, changed = dedup_lines(docs), F.col("n_dropped") > 0
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return out.select(*[F.when(changed, new[c]).otherwise(F.col("doc").getField(c)).alias(c) if c in new else F.col("doc").getField(c).alias(c)
                        for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays (and rows that repeat that id in the group)."""
    found = simhash_dedup(docs, shingle=3, max_bits=3)
    gone = (found.where(~F.col("doc_id").eqNullSafe(F.col("component_id")))
            .select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct())
    rows = docs.select(F.struct("*").alias("doc"))
    same = F.col("doc.doc_id").eqNullSafe(F.col("gone_id")) & (F.xxhash64(F.coalesce("doc.text", F.lit(""))) == F.col("gone_hash"))
    return rows.join(gone, same, "left_anti").select("doc.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words at least a twentieth are in benchmark passages go."""
    found = find_contamination(docs, _table(spark, sf_dir, "benchmark"))
    return found.where(~contaminated()).select("doc.*")


def pack_digest(pieces: DataFrame) -> DataFrame:
    """The packed pieces with the checksum of their ids in place of the ids."""
    return pieces.select("doc.doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_digest(pack_documents(docs.select("doc_id", "text"), added_tokens=True))
