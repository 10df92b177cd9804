"""C — profiling aggregates: every column in one pass, results as long frames.

Wide one-row aggregates are turned into one row per column with
``explode(array(struct…))`` on the single aggregated row, so a profile of any
number of columns is one scan and one tiny exchange. Exact quantiles use the
sketch-then-refine plan (``plans.quantiles``: approximate brackets, exact
ranking of the bracketed rows only); ``exact=False`` switches to
``percentile_approx`` inside the same single aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.fit import (clean_value, col, dtype_of, is_numeric, long_form, missing_cond, numeric_columns,
                         qualitative_columns)
from ..plans.quantiles import exact_quantiles_wide
from .columns import role_of, round_half_even, type_name

QUARTILES = (0.25, 0.5, 0.75)


def _explode_structs(agg_df: DataFrame) -> DataFrame:
    """One aggregated row holding ``_a`` = array<struct> → one row per struct."""
    return agg_df.select(F.explode("_a").alias("_s")).select("_s.*")


def describe_numeric(df: DataFrame, cols: Sequence[str] | None = None, exact: bool = True,
                     digits: int | None = None) -> DataFrame:
    """Variable, count, mean, std, min, q25, q50, q75, max, missing.

    count excludes NULL/NaN; std is the sample (ddof=1) deviation; quartiles
    use linear interpolation. ``digits`` rounds float outputs half-to-even.
    """
    cols = list(cols) if cols else numeric_columns(df)
    if not cols:
        raise ValueError("no numeric columns to describe")
    structs = []
    for c in cols:
        x = clean_value(df, c).cast("double")
        parts = [F.lit(c).alias("variable"),
                 F.count(x).alias("count"),
                 F.avg(x).alias("mean"),
                 F.stddev_samp(x).alias("std"),
                 F.min(x).alias("min"),
                 F.max(x).alias("max"),
                 F.count_if(missing_cond(df, c)).alias("missing")]
        if not exact:
            parts.append(F.percentile_approx(x, list(QUARTILES), 100_000).alias("q"))
        structs.append(F.struct(*parts))
    moments = _explode_structs(df.agg(F.array(*structs).alias("_a")))
    if exact:
        qs = exact_quantiles_wide(df, {c: clean_value(df, c).cast("double") for c in cols}, QUARTILES).select("variable", "q")
        moments = moments.join(F.broadcast(qs), on="variable", how="left")  # one row a column
    out = moments.select(
        "variable", "count", "mean", "std", "min",
        F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"),
        "max", "missing")
    if digits is not None:
        out = out.select("variable", "count",
                         *[round_half_even(F.col(c), digits).alias(c)
                           for c in ("mean", "std", "min", "q25", "q50", "q75", "max")],
                         "missing")
    return out


def category_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(variable, value, cnt) for every column in ``cols`` cast to text; NULL kept."""
    return (long_form(df, cols, "string")
            .groupBy("variable", "value").agg(F.count(F.lit(1)).alias("cnt")))


def mode_order(df: DataFrame, cols: Sequence[str]) -> Column:
    """What the minimum over (variable, value, cnt) rows is taken of to get the mode: the most
    frequent value, on ties the smallest — as a number in numeric columns, as text in others."""
    numbers = [c for c in cols if is_numeric(dtype_of(df, c))]
    number = F.when(F.col("variable").isin(numbers), F.col("value").try_cast("double"))
    return F.struct((-F.col("cnt")).alias("k"), number.alias("x"), F.col("value").alias("v"))


def describe_categorical(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Variable, count, unique, top, freq, missing — two small shuffles total.

    ``top`` is the most frequent non-null value, the smallest one on ties.
    """
    cols = list(cols) if cols else qualitative_columns(df)
    if not cols:
        raise ValueError("no qualitative columns to describe")
    present = F.col("value").isNotNull()
    return (category_counts(df, cols)
            .groupBy("variable")
            .agg(F.coalesce(F.sum(F.when(present, F.col("cnt"))), F.lit(0)).cast("long").alias("count"),
                 F.count("value").alias("unique"),
                 F.min(F.when(present, F.struct((-F.col("cnt")).alias("k"), F.col("value").alias("v"))))
                 .alias("_top"),
                 F.max(F.when(present, F.col("cnt"))).alias("freq"),
                 F.coalesce(F.sum(F.when(~present, F.col("cnt"))), F.lit(0)).cast("long").alias("missing"))
            .select("variable", "count", "unique", F.col("_top.v").alias("top"), "freq", "missing"))


def missing_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(variable, dtype, role, missing, rows) for every column; one aggregate."""
    cols = list(cols) if cols else df.columns
    structs = [F.struct(F.lit(c).alias("variable"),
                        F.lit(type_name(df.schema[c].dataType)).alias("dtype"),
                        F.lit(role_of(df.schema[c].dataType)).alias("role"),
                        F.count_if(missing_cond(df, c)).alias("missing"),
                        F.count(F.lit(1)).alias("rows")) for c in cols]
    return df.agg(F.array(*structs).alias("_a")).select(F.explode("_a").alias("_s")).select("_s.*")


def missing_report(df: DataFrame, digits: int = 2) -> DataFrame:
    """Columns with ≥1 missing value: variable, missing, pct, dtype (sorted desc)."""
    mc = missing_counts(df).where(F.col("missing") > 0)
    pct = F.col("missing") / F.col("rows") * F.lit(100)
    if digits is not None:
        pct = round_half_even(pct, digits)
    return (mc.select("variable", "missing", pct.alias("pct"), "dtype")
            .orderBy(F.desc("missing"), "variable"))


def missing_columns(df: DataFrame, role: str | None = None) -> DataFrame:
    """C4: (variable, role, missing) of columns having nulls, optionally one role."""
    mc = missing_counts(df).where(F.col("missing") > 0).select("variable", "role", "missing")
    return mc.where(F.col("role") == role) if role else mc


def mode_report(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Variable, mode (as text), freq, pct — nulls ignored, smallest mode on ties.

    ``pct`` is the share of *all* rows (nulls stay in the denominator).
    """
    cols = list(cols) if cols else qualitative_columns(df)
    counts = category_counts(df, cols)
    present = F.col("value").isNotNull()
    return (counts.groupBy("variable")
            .agg(F.min(F.when(present, mode_order(df, cols))).alias("_m"),
                 F.sum("cnt").alias("rows"))
            .where(F.col("_m").isNotNull())
            .select("variable", F.col("_m.v").alias("mode"), (-F.col("_m.k")).alias("freq"),
                    (-F.col("_m.k") / F.col("rows") * F.lit(100)).alias("pct")))


def duplicate_count(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Rows, distinct_rows, duplicates (rows repeating an earlier row).

    ``groupBy`` groups NULL with NULL (as pandas ``duplicated`` does); the
    partial aggregate collapses hot keys before the shuffle.
    """
    keys = list(subset) if subset else df.columns
    groups = df.groupBy(*map(col, keys)).agg(F.count(F.lit(1)).alias("_c"))
    return groups.agg(F.coalesce(F.sum("_c"), F.lit(0)).cast("long").alias("rows"),
                      F.count(F.lit(1)).alias("distinct_rows")) \
        .select("rows", "distinct_rows", (F.col("rows") - F.col("distinct_rows")).alias("duplicates"))


def row_count(df: DataFrame) -> DataFrame:
    """Number of rows as a one-row frame."""
    return df.agg(F.count(F.lit(1)).alias("rows"))
