"""Line dedup (operator 1): sharded minimal perfect hash over repeated lines.

1. One aggregate over line hashes finds the lines held by enough documents, how
   many hold each, and its keeper (the largest doc_id).
2. Those keys are cut into shards; each shard becomes one row: a minimal perfect
   hash and, in its slots, a 64-bit fingerprint, a count and a keeper.
3. Documents send their line hashes to the shards, which probe the arrays; only
   the places of lines to drop come back. Lines are never joined by text. A
   shard with much-repeated lines is copied to several tasks, each of which
   takes some of the documents, so one line in a third of the corpus is split.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import mph
from .common import NO_ID, SPACES, bounded_batches, cut, lower_ascii, shuffle_parts

_INDEX = "shard long, sizes binary, words binary, fingerprints binary, counts binary, keepers binary"


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(SPACES)))


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")]


def repeated_lines(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """(h1, h2, n_docs, keeper) of keys found in at least ``min_docs`` rows of (id, text)."""
    keys = F.transform(F.split("text", "\n", -1), line_key)
    keys = F.array_distinct(F.filter(keys, lambda k: F.length(k) >= min_chars))
    return (docs.select("id", F.explode(keys).alias("key"))
            .select("id", *_hashes(F.col("key")))
            .groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("id").alias("keeper"))
            .where(F.col("n_docs") >= min_docs))


def _build_shard(key, table):
    col = {c: table[c].to_numpy() for c in ("h1", "h2", "n_docs", "keeper")}
    h1, h2 = col["h1"].view("u8"), col["h2"].view("u8")
    sizes, words, slot = mph.build(h1, h2)
    order = np.empty(len(slot), np.int64)
    order[slot] = np.arange(len(slot))
    arrays = [sizes.astype("<i8"), words, h2[order], col["n_docs"][order].astype("<i8"), col["keeper"][order].astype("<i8")]
    return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int64()), *[pa.array([a.tobytes()], pa.binary()) for a in arrays]],
                                names=["shard", "sizes", "words", "fingerprints", "counts", "keepers"])


def line_index(repeated: DataFrame, n_shards: int) -> DataFrame:
    """One row per shard of the index; a shard's keys fit one task by choice of ``n_shards``."""
    return (repeated.withColumn("shard", F.pmod("h1", F.lit(n_shards)))
            .groupBy("shard").applyInArrow(_build_shard, _INDEX))


def _probe(min_docs: int):
    def run(lines, index):
        drop = np.zeros(len(lines), bool)
        if len(lines) and len(index):
            array = lambda c, kind: np.frombuffer(index[c][0].as_py(), kind)
            h1, h2 = (lines[c].to_numpy().view("u8") for c in ("h1", "h2"))
            slot = mph.slots(array("sizes", "<i8"), array("words", "<u8"), h1, h2)
            at = np.flatnonzero(slot >= 0)
            at = at[array("fingerprints", "<u8")[slot[at]] == h2[at]]
            at = at[array("counts", "<i8")[slot[at]] >= min_docs]
            drop[at] = array("keepers", "<i8")[slot[at]] != lines["id"].to_numpy()[at]
        return lines.select(["id", "text_hash", "pos"]).filter(pa.array(drop))
    return run


def _kept_text(texts: pa.Array, drops: pa.Array) -> pa.Array:
    out = []
    for text, gone in zip(texts.to_pylist(), drops.to_pylist()):
        if text is not None:
            gone = set(gone)
            text = "\n".join(line for i, line in enumerate(text.split("\n")) if i not in gone)
        out.append(text)
    return pa.array(out, pa.string())


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = 40,
                min_docs: int = 5, shard_keys: int = 1 << 14) -> DataFrame:
    """Drop lines that many documents share, except in the largest doc_id that holds them.

    A line's key is the line without ASCII white space at its ends and with A-Z
    lower-cased. Keys of at least ``min_chars`` code points in at least
    ``min_docs`` documents lose all their lines but those in the keeper.

    Returns one row per input row: ``doc`` (the whole input row as a struct, so
    no name can clash), ``kept_text``, ``n_lines`` (before dropping),
    ``n_dropped``.

    Null or empty text is one empty line and stays ''. Every row is a document
    of its own when documents are counted; rows that repeat the keeper's doc_id
    all keep the line. A null doc_id is smaller than any other. ``doc_id`` must
    be an integer column. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    ident = F.coalesce(F.col("doc").getField(doc_id).cast("long"), F.lit(NO_ID))
    content = F.coalesce(F.col("doc").getField(text), F.lit(""))
    rows = docs.select(F.struct("*").alias("doc"))
    plain = rows.select(ident.alias("id"), content.alias("text"))

    repeated = cut(repeated_lines(plain, min_chars, min_docs), "lines")
    total = repeated.agg(F.count(F.lit(1)).alias("keys"), F.sum("n_docs").alias("uses")).first()
    n_shards = max(1, -(-total["keys"] // shard_keys))
    parts = 2 * shuffle_parts(spark)
    index = line_index(repeated, n_shards)
    # How many tasks share a shard: an even part, and more for shards of much-used lines.
    copies = (repeated.groupBy(F.pmod("h1", F.lit(n_shards)).alias("shard"))
              .agg((-(-parts // n_shards) + F.floor(F.lit(parts) * F.sum("n_docs") / max(1, total["uses"] or 0))).alias("copies")))
    copies = F.broadcast(copies)  # one row per shard, that is per `shard_keys` repeated lines

    line = F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")
    lines = (plain.select("id", F.xxhash64("text").alias("text_hash"), line)
             .select("id", "text_hash", "pos", line_key(F.col("line")).alias("key"))
             .where(F.length("key") >= min_chars)
             .select("id", "text_hash", "pos", *_hashes(F.col("key")))
             .withColumn("shard", F.pmod("h1", F.lit(n_shards)))
             .join(copies, "shard")
             .withColumn("part", F.pmod(F.xxhash64("id", "text_hash"), "copies")).drop("copies"))
    index = index.join(copies, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    dropped = (lines.groupBy("shard", "part").cogroup(index.groupBy("shard", "part"))
               .applyInArrow(_probe(min_docs), "id long, text_hash long, pos int")
               .groupBy("id", "text_hash").agg(F.collect_set("pos").alias("gone")))

    kept = F.arrow_udf(_kept_text, "string")
    return (rows.withColumn("id", ident).withColumn("text_hash", F.xxhash64(content))
            .join(dropped, ["id", "text_hash"], "left")
            .select("doc", F.coalesce(kept(F.when(F.col("gone").isNotNull(), content), F.col("gone")), content).alias("kept_text"),
                    F.size(F.split(content, "\n", -1)).cast("long").alias("n_lines"),
                    F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped")))
