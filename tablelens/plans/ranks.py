"""R1 — distributed ranking, exact quantiles and order-statistic expansion.

Sorting a whole column with an un-partitioned window puts every row in one
task. Instead:

1. Split points of the *value domain* from ``percentile_approx`` over the raw
   rows (map-side sketches, nothing is shuffled; a bounded list is collected).
   A JVM ``Bucketizer`` (binary search) gives every row its value range.
2. ``groupBy(keys, range, value).count()`` — map-side partial aggregation, so a
   hot value costs one row per task, not one row per occurrence. The distinct
   values are written once as a stage and everything later reads that.
3. Per (keys, range) totals — at most #keys × #ranges rows — give each range's
   offset with a window partitioned by the keys (for whole-table ranks the
   ≤ #ranges totals are collected and looked up by broadcast).
4. A running sum partitioned by (keys, range) and ordered by value gives the
   number of rows strictly below every distinct value.

The result has one row per distinct (keys, value) with ``cnt`` (occurrences),
``below`` (rows with a smaller value) and ``n`` (rows in the key). Everything
else — average ranks, quantiles, the sorted sample — is derived from it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .fit import BROADCAST_KEYS, collect_bounded, materialize, one_row

# Buckets per ranking: 4 per shuffle partition, capped so the collected split
# list and the broadcast offsets stay small.
_MAX_BUCKETS = 16_384
#: Index values in a range, and rows of a range that one task looks up.
_INDEX_VALUES = 50_000
_RANGE_ROWS = 1 << 20


def _bucket_count(spark) -> int:
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(1, min(_MAX_BUCKETS, 4 * parts))


def value_offsets(df: DataFrame, value: str, keys: Sequence[str] = (),
                  n_buckets: int | None = None) -> DataFrame:
    """One row per distinct non-null (keys, value): keys…, value, cnt, below, n.

    ``value`` must be numeric; it is compared as DOUBLE.
    """
    keys = list(keys)
    spark = df.sparkSession
    # + 0.0 makes -0.0 zero: the Bucketizer tells them apart, grouping does not.
    rows = (df.select(*keys, (F.col(value).cast("double") + F.lit(0.0)).alias("value"))
            .where(F.col("value").isNotNull() & ~F.isnan("value")))
    count = F.count(F.lit(1)).alias("cnt")
    nb = n_buckets or _bucket_count(spark)
    if keys and nb == 1:
        # Caller-bounded keys (e.g. quantile brackets): one window per key suffices.
        per_key = Window.partitionBy(*keys)
        ordered = per_key.orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
        return rows.groupBy(*keys, "value").agg(count).select(
            *keys, "value", "cnt", F.coalesce(F.sum("cnt").over(ordered), F.lit(0)).alias("below"),
            F.sum("cnt").over(per_key).alias("n"))
    splits: list[float] = []
    if nb > 1:
        probs = [i / nb for i in range(1, nb)]
        row = one_row(rows.agg(F.percentile_approx("value", probs, max(10_000, 20 * nb)).alias("s")))
        splits = sorted({float(s) for s in row["s"] or []})
    edges = [-math.inf] + [s for s in splits if math.isfinite(s)] + [math.inf]
    if len(edges) > 2:
        bucketed = Bucketizer(splits=edges, inputCol="value", outputCol="_b",
                              handleInvalid="keep").transform(rows)
        bucketed = bucketed.withColumn("_b", F.col("_b").cast("int"))
    else:
        bucketed = rows.withColumn("_b", F.lit(0))
    bucketed = materialize(bucketed.groupBy(*keys, "_b", "value").agg(count))
    totals = bucketed.groupBy(*keys, "_b").agg(F.sum("cnt").alias("_bcnt"))
    wb = (Window.partitionBy(*keys, "_b").orderBy("value")
          .rowsBetween(Window.unboundedPreceding, -1))
    within = F.coalesce(F.sum("cnt").over(wb), F.lit(0))
    if not keys:
        # Whole-table ranks: the bucket totals are at most len(edges) rows, so their
        # prefix offsets are computed on the driver and looked up by bucket — no
        # single-partition window.
        counts = {int(r["_b"]): int(r["_bcnt"]) for r in collect_bounded(totals, len(edges))}
        offs, run = [], 0
        for b in sorted(counts):
            offs.append((b, run))
            run += counts[b]
        looked_up = F.broadcast(spark.createDataFrame(offs, "_b int, _boff long"))  # at most _MAX_BUCKETS rows
        return bucketed.join(looked_up, "_b").select("value", "cnt", (F.col("_boff") + within).alias("below"),
                                                     F.lit(run).cast("long").alias("n"))
    wk = Window.partitionBy(*keys)
    totals = (totals
              .withColumn("_boff", F.coalesce(
                  F.sum("_bcnt").over(wk.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)),
                  F.lit(0)))
              .withColumn("n", F.sum("_bcnt").over(wk)))
    joined = bucketed.join(totals.select(*keys, "_b", "_boff", "n"), on=[*keys, "_b"], how="inner")
    return joined.select(*keys, "value", "cnt", (F.col("_boff") + within).alias("below"), "n")


def average_ranks(offsets: DataFrame) -> DataFrame:
    """Adds ``rank`` = 1-based average rank of each distinct value (ties averaged)."""
    return offsets.withColumn("rank", F.col("below") + (F.col("cnt") + F.lit(1)) / F.lit(2.0))


def _look_up(keys: list[str]):
    """Cogroup of a range's rows and its part of the index: each row's rank by binary search among the sorted values."""
    def run(rows: pa.Table, index: pa.Table) -> pa.Table:
        values, ranks = index.column("value").to_numpy(), index.column("rank").to_numpy()
        order = np.argsort(values)
        at = np.searchsorted(values[order], rows.column("_v").to_numpy())
        return pa.table([*(rows.column(c) for c in [*keys, "_row"]), pa.array(ranks[order][at] if len(at) else np.zeros(0))],
                        names=[*keys, "_row", "_rank"])
    return run


def with_ranks(df: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """(keys…, ``_r0``, ``_r1``, …): the average rank of each row's value in every column, within its key.

    ``columns`` are DOUBLE without nulls. All columns are ranked in one R1 plan, whose
    distinct values with their ranks are the index. If that is small it is
    broadcast. If not, the rows go to the value ranges of the index, (key, column,
    range), and look their value up there by binary search; ranges of many rows
    are dealt to several tasks. Rows never move by a value itself, which may be hot.
    """
    keys = list(keys)
    rows = df.select(*keys, *columns)
    each = F.array(*[F.struct(F.lit(i).alias("_i"), (F.col(c) + F.lit(0.0)).alias("_v")) for i, c in enumerate(columns)])
    long = rows.select(*keys, F.explode(each).alias("_s")).select(*keys, "_s.*")
    index = materialize(average_ranks(value_offsets(long, "_v", [*keys, "_i"])).select(*keys, "_i", "value", "rank", "cnt"))
    size = index.count()
    if size <= BROADCAST_KEYS:
        for i, c in enumerate(columns):
            own = F.broadcast(index.where(F.col("_i") == i).select(*keys, F.col("value").alias(c), F.col("rank").alias(f"_r{i}")))
            rows = rows.join(own, [*keys, c])
        return rows.select(*keys, *[f"_r{i}" for i in range(len(columns))])
    n = min(_MAX_BUCKETS, math.ceil(size / _INDEX_VALUES))
    splits = one_row(index.agg(F.percentile_approx("value", [k / n for k in range(1, n)] or [0.5], max(10_000, 20 * n)).alias("s")))["s"]
    edges = [-math.inf, *sorted({float(x) for x in splits}), math.inf]

    def ranged(frame: DataFrame, value: str) -> DataFrame:
        return Bucketizer(splits=edges, inputCol=value, outputCol="_b", handleInvalid="keep").transform(frame)
    index = ranged(index, "value")
    place = [*keys, "_i", "_b"]
    dealt = materialize(index.groupBy(*place).agg(F.ceil(F.sum("cnt") / _RANGE_ROWS).cast("int").alias("_salts")))
    many = dealt.where(F.col("_salts") > 1).withColumnRenamed("_salts", "_tasks")
    numbered = materialize(rows.withColumn("_row", F.monotonically_increasing_id()))
    long = numbered.select(*keys, "_row", F.explode(each).alias("_s")).select(*keys, "_row", "_s.*")
    # Only ranges of over _RANGE_ROWS rows are listed: at most as many as the rows allow.
    salted = (ranged(long, "_v").join(F.broadcast(many), place, "left")
              .withColumn("_salt", F.pmod(F.xxhash64("_row"), F.coalesce("_tasks", F.lit(1))).cast("int")))
    parts = index.join(dealt, place).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
    schema = ", ".join(f"`{c}` {numbered.schema[c].dataType.simpleString()}" for c in keys)
    found = (salted.groupBy(*place, "_salt").cogroup(parts.groupBy(*place, "_salt"))
             .applyInArrow(_look_up([*keys, "_i"]), f"{schema}, _i int, _row long, _rank double"))
    wide = found.groupBy(*keys, "_row").agg(*[F.max(F.when(F.col("_i") == i, F.col("_rank"))).alias(f"_r{i}") for i in range(len(columns))])
    return wide.drop("_row")


def quantiles_from_offsets(offsets: DataFrame, probs: Sequence[float],
                           keys: Sequence[str] = ()) -> DataFrame:
    """Linear-interpolation quantiles (numpy/pandas default) per key.

    Returns keys…, ``n``, ``q`` = array of quantiles in ``probs`` order.
    Only rows containing one of the 2·len(probs) needed positions survive the
    filter, so the final aggregate sees a handful of rows per key.
    """
    keys = list(keys)
    probs_arr = F.array(*[F.lit(float(p)) for p in probs])
    h = F.expr("transform(_probs, p -> (n - 1) * p)")
    with_pos = offsets.withColumn("_probs", probs_arr).withColumn("_h", h)
    contains = F.expr(
        "exists(_h, x -> (floor(x) >= below AND floor(x) < below + cnt) OR "
        "(least(floor(x) + 1, n - 1) >= below AND least(floor(x) + 1, n - 1) < below + cnt))")
    needed = with_pos.where(contains)
    exploded = needed.select(*keys, "value", "below", "cnt", "n",
                             F.posexplode("_h").alias("_pi", "_hp"))
    lo = F.floor("_hp")
    hi = F.least(lo + 1, F.col("n") - 1)
    per_prob = (exploded
                .groupBy(*keys, "_pi")
                .agg(F.max(F.when((lo >= F.col("below")) & (lo < F.col("below") + F.col("cnt")),
                                  F.col("value"))).alias("_vlo"),
                     F.max(F.when((hi >= F.col("below")) & (hi < F.col("below") + F.col("cnt")),
                                  F.col("value"))).alias("_vhi"),
                     F.max(F.col("_hp") - F.floor("_hp")).alias("_frac"),
                     F.max("n").alias("n")))
    per_prob = per_prob.withColumn(
        "_q", F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * F.col("_frac"))
    return (per_prob.groupBy(*keys)
            .agg(F.max("n").alias("n"),
                 F.array_sort(F.collect_list(F.struct("_pi", "_q"))).alias("_qs"))
            .select(*keys, "n", F.transform("_qs", lambda s: s["_q"]).alias("q")))


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float],
                    keys: Sequence[str] = ()) -> DataFrame:
    return quantiles_from_offsets(value_offsets(df, value, keys), probs, keys)


def sorted_positions(offsets: DataFrame, keys: Sequence[str] = (),
                     chunk: int = 1_000_000) -> DataFrame:
    """Expand distinct values back to the sorted sample: keys…, pos (1-based), value, n.

    A value occurring ``cnt`` times yields positions below+1 … below+cnt.
    Every value is first cut into descriptors of at most ``chunk`` positions,
    which are spread over tasks, so no single task expands a hot value.
    """
    keys = list(keys)
    parts = int(offsets.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    chunks = (offsets
              .select(*keys, "value", "n", "below", "cnt",
                      F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("cnt") - 1) / chunk).cast("long"))).alias("_j"))
              .repartition(parts))
    start = F.col("below") + 1 + F.col("_j") * chunk
    end = F.least(F.col("below") + F.col("cnt"), start + chunk - 1)
    return chunks.select(*keys, "value", "n", F.explode(F.sequence(start, end)).alias("pos"))


def keyed_offsets(df: DataFrame, value: str, keys: Sequence[str], grouped: bool) -> DataFrame:
    """:func:`value_offsets` for callers that carry a constant key when ungrouped:
    the whole-table path ranks without the key and adds it back afterwards."""
    if grouped:
        return value_offsets(df, value, keys)
    out = value_offsets(df.drop(*keys), value, [])
    return out.select(*[F.lit(0).alias(k) for k in keys], *out.columns)


__all__ = ["value_offsets", "average_ranks", "with_ranks", "quantiles_from_offsets", "exact_quantiles",
           "sorted_positions", "keyed_offsets"]
