"""G — deduplication with a deterministic survivor and no window.

The survivor of a group is ``min(struct(order_by…, other columns…))``. A struct
has no fixed width, so Spark runs this as a sort aggregate: each task sorts its
rows by key before the partial phase. That phase keeps one candidate per key
per task, so a key holding a third of the table costs one row per task in the
shuffle instead of a third of the table in one window partition. Whole-row
comparison (no subset) is ``distinct``, a hash aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.fit import col


def _keys(df: DataFrame, subset: Sequence[str] | None) -> list[str]:
    return list(subset) if subset else list(df.columns)


def dedupe(df: DataFrame, subset: Sequence[str] | None = None, keep: str | bool = "first",
           order_by: Sequence[str] | None = None) -> DataFrame:
    """``keep='first'`` keeps the first row per key in ``order_by`` order;
    ``keep='last'`` the last; ``keep=False`` drops every row of a duplicated key.

    With no subset, whole rows are compared and survivors are identical, so
    ``distinct`` (a partial hash aggregate) is used.
    """
    keys = _keys(df, subset)
    if keep not in ("first", "last", False):
        raise ValueError("keep must be 'first', 'last' or False")
    if keep is False:
        others = [c for c in df.columns if c not in keys]
        agg = df.groupBy(*map(col, keys)).agg(F.count(F.lit(1)).alias("_n"),
                                              *([F.min(F.struct(*map(col, others))).alias("_r")] if others else []))
        kept = agg.where(F.col("_n") == 1)
        return kept.select(*[col(c) if c in keys else F.col("_r").getField(c).alias(c) for c in df.columns])
    if not subset or set(keys) == set(df.columns):
        return df.distinct()
    order = [c for c in (order_by or []) if c not in keys]
    others = [c for c in df.columns if c not in keys and c not in order]
    payload = F.struct(*[col(c) for c in order + others])
    pick = F.min(payload) if keep == "first" else F.max(payload)
    agg = df.groupBy(*map(col, keys)).agg(pick.alias("_r"))
    return agg.select(*[col(c) if c in keys else F.col("_r").getField(c).alias(c) for c in df.columns])


def dedupe_report(df: DataFrame, subset: Sequence[str] | None = None, keep: str | bool = "first") -> DataFrame:
    """Initial, remaining, removed, pct_removed — from one grouped aggregate."""
    keys = _keys(df, subset)
    groups = df.groupBy(*map(col, keys)).agg(F.count(F.lit(1)).alias("_n"))
    remaining = (F.count_if(F.col("_n") == 1) if keep is False else F.count(F.lit(1)))
    return (groups.agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("initial"),
                       remaining.alias("remaining"))
            .select("initial", "remaining", (F.col("initial") - F.col("remaining")).alias("removed"),
                    F.when(F.col("initial") > 0,
                           (F.col("initial") - F.col("remaining")) / F.col("initial") * F.lit(100))
                    .alias("pct_removed")))
