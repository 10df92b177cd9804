"""D — missing-value treatment: fit = one aggregate, transform = one projection.

``fit_imputer`` runs the aggregates (means and modes in one pass; medians via
the exact sketch-then-refine quantile plan) and returns an :class:`ImputeModel` holding
a handful of literals. ``ImputeModel.transform`` is a pure ``coalesce``
projection, so it also applies unchanged to a streaming DataFrame. KNN fill is
its own sub-plan (``operators.knn``).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.fit import clean_value, col, is_numeric, missing_cond, one_row
from ..plans.quantiles import exact_quantiles_wide
from .profile import category_counts, missing_counts, mode_order

METHODS = ("mean", "median", "zero", "mode", "knn")


class ImputePlanError(ValueError):
    pass


@dataclass
class ImputeModel:
    methods: dict[str, str]                       # column -> method
    values: dict[str, object] = field(default_factory=dict)   # column -> fill literal
    types: dict[str, T.DataType] = field(default_factory=dict)
    knn_k: int = 5
    knn_features: list[str] = field(default_factory=list)
    knn_order: list[str] = field(default_factory=list)
    complete: set[str] = field(default_factory=set)   # columns with no missing value: left as is

    def fill_expr(self, name: str, source: DataFrame) -> Column:
        method = self.methods[name]
        if name in self.complete:
            return col(name)
        value = self.values.get(name)
        base = clean_value(source, name)
        if method == "zero":
            return F.coalesce(base, F.lit(0).cast(self.types[name]))
        if value is None:
            return base
        if method == "mode":
            return F.coalesce(base, F.lit(value).cast(self.types[name]))
        return F.coalesce(base.cast("double"), F.lit(float(value)))

    def transform(self, df: DataFrame) -> DataFrame:
        def filled(frame: DataFrame, methods: tuple[str, ...]) -> DataFrame:
            return frame.select(*[self.fill_expr(c, frame).alias(c) if self.methods.get(c) in methods else col(c)
                                  for c in frame.columns])

        knn_cols = [c for c, m in self.methods.items() if m == "knn"]
        if not knn_cols:
            return filled(df, ("mean", "median", "zero", "mode"))
        from .knn import knn_impute
        # Neighbours are sought among mean-filled features, not zero-filled ones.
        out = knn_impute(filled(df, ("mean", "median")), knn_cols, k=self.knn_k,
                         features=self.knn_features or None, order_by=self.knn_order or None)
        return filled(out, ("zero", "mode"))


def _plan(mean=(), median=(), zero=(), mode=(), knn=()) -> dict[str, str]:
    plan: dict[str, str] = {}
    for method, cols in (("mean", mean), ("median", median), ("zero", zero),
                         ("mode", mode), ("knn", knn)):
        for c in cols:
            if c in plan:
                raise ImputePlanError(f"column {c!r} is assigned to both {plan[c]} and {method}")
            plan[c] = method
    return plan


def validate_plan(df: DataFrame, strict: bool = False, **methods: Sequence[str]) -> dict:
    """Conflicts raise; columns with missing values and no method are listed.

    Returns {"plan": …, "untreated": [...]}; ``strict=True`` raises on untreated.
    """
    plan = _plan(**methods)
    for c, m in plan.items():
        if c not in df.columns:
            raise ImputePlanError(f"unknown column {c!r}")
        if m in ("mean", "median", "zero", "knn") and not is_numeric(df.schema[c].dataType):
            raise ImputePlanError(f"{m} fill needs a numeric column, {c!r} is "
                                  f"{df.schema[c].dataType.simpleString()}")
    counts = missing_counts(df).where(F.col("missing") > 0).select("variable").collect()
    untreated = sorted(r["variable"] for r in counts if r["variable"] not in plan)
    if strict and untreated:
        raise ImputePlanError(f"columns with missing values and no method: {untreated}")
    return {"plan": plan, "untreated": untreated}


def fit_imputer(df: DataFrame, mean: Sequence[str] = (), median: Sequence[str] = (),
                zero: Sequence[str] = (), mode: Sequence[str] = (), knn: Sequence[str] = (),
                k: int = 5, knn_features: Sequence[str] | None = None,
                knn_order: Sequence[str] | None = None) -> ImputeModel:
    plan = _plan(mean, median, zero, mode, knn)
    for c in plan:
        if c not in df.columns:
            raise ImputePlanError(f"unknown column {c!r}")
    model = ImputeModel(plan, types={c: df.schema[c].dataType for c in df.columns},
                        knn_k=k, knn_features=list(knn_features or []),
                        knn_order=list(knn_order or []))
    # One aggregate: means plus the missing counts
    # (columns without a missing value are skipped, as in the reference).
    aggs = ([F.avg(clean_value(df, c).cast("double")).alias(c) for c in mean]
            + [F.count_if(missing_cond(df, c)).alias(f"_m_{c}") for c in plan if plan[c] not in ("knn", "mode")])
    if aggs:
        row = one_row(df.agg(*aggs))
        model.values.update({c: row[c] for c in mean})
        model.complete = {c for c in plan if plan[c] not in ("knn", "mode") and row[f"_m_{c}"] == 0}
    if median:
        rows = exact_quantiles_wide(df, {c: clean_value(df, c).cast("double") for c in median}, [0.5]).collect()
        model.values.update({r["variable"]: r["q"][0] for r in rows})
    if mode:  # the counts of values also tell how many are missing
        present = F.col("value").isNotNull()
        modes = (category_counts(df, list(mode)).groupBy("variable")
                 .agg(F.min(F.when(present, mode_order(df, mode))).alias("m"), F.coalesce(F.sum(F.when(~present, F.col("cnt"))), F.lit(0)).alias("missing"))
                 .select("variable", F.col("m.v").alias("v"), "missing").collect())
        model.values.update({r["variable"]: r["v"] for r in modes})
        model.complete |= {r["variable"] for r in modes if r["missing"] == 0}
    return model


def impute(df: DataFrame, mean: Sequence[str] = (), median: Sequence[str] = (),
           zero: Sequence[str] = (), mode: Sequence[str] = (), knn: Sequence[str] = (),
           k: int = 5, knn_features: Sequence[str] | None = None,
           knn_order: Sequence[str] | None = None) -> DataFrame:
    """Fill missing values column by column (apply order mean → KNN → zero → mode)."""
    return fit_imputer(df, mean, median, zero, mode, knn, k, knn_features, knn_order).transform(df)


def impute_report(df: DataFrame, model: ImputeModel, filled: DataFrame | None = None,
                  with_total: bool = False) -> DataFrame:
    """Variable, method, missing_before, missing_after, fill_value, fill_label, success_pct
    (``with_total`` appends a TOTAL row).

    For the projection-only methods both counts come from one aggregate over
    the source (the fill expression is evaluated inline); KNN columns are
    counted on ``filled``.
    """
    cols = list(model.methods)
    simple = [c for c in cols if model.methods[c] != "knn"]
    knn_cols = [c for c in cols if model.methods[c] == "knn"]
    structs = []
    for c in simple:
        after = model.fill_expr(c, df)
        structs.append(F.struct(F.lit(c).alias("variable"),
                                F.count_if(missing_cond(df, c)).alias("missing_before"),
                                F.count_if(after.isNull()).alias("missing_after")))
    frames = []
    if structs:
        frames.append(df.agg(F.array(*structs).alias("_a")).select(F.explode("_a").alias("_s"))
                      .select("_s.*"))
    if knn_cols:
        if filled is None:
            filled = model.transform(df)
        before = df.agg(*[F.count_if(missing_cond(df, c)).alias(c) for c in knn_cols])
        after = filled.agg(*[F.count_if(col(c).isNull()).alias(c) for c in knn_cols])
        b, a = one_row(before), one_row(after)
        frames.append(df.sparkSession.createDataFrame(
            [(c, int(b[c]), int(a[c])) for c in knn_cols],
            "variable string, missing_before long, missing_after long"))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    meta = [(c, model.methods[c],
             float(model.values[c]) if model.methods[c] in ("mean", "median") and model.values.get(c) is not None
             else (0.0 if model.methods[c] == "zero" else None),
             str(model.values[c]) if model.methods[c] == "mode" and model.values.get(c) is not None else None)
            for c in cols]
    meta_df = df.sparkSession.createDataFrame(
        meta, "variable string, method string, fill_value double, fill_label string")
    success = F.when(F.col("missing_before") > 0,
                     F.lit(100.0) - F.col("missing_after") / F.col("missing_before") * F.lit(100.0))
    per_col = (out.join(F.broadcast(meta_df), "variable")
               .select("variable", "method", "missing_before", "missing_after", "fill_value", "fill_label"))
    if not with_total:
        return per_col.withColumn("success_pct", success)
    total = per_col.agg(F.lit("TOTAL").alias("variable"), F.lit(None).cast("string").alias("method"),
                        F.sum("missing_before").alias("missing_before"),
                        F.sum("missing_after").alias("missing_after"),
                        F.lit(None).cast("double").alias("fill_value"),
                        F.lit(None).cast("string").alias("fill_label"))
    return per_col.unionByName(total).withColumn("success_pct", success)


def impute_preview(df: DataFrame, model: ImputeModel, order_by: Sequence[str], n: int = 3) -> DataFrame:
    """Up to ``n`` changed rows per column (smallest ``order_by`` first).

    variable, method, <order_by…>, before ('NA'), after_value (numeric fills),
    after_label (mode fills). With KNN columns ``order_by`` must be the unique row
    key. ``row_number() <= n`` per variable is planned with
    a partial WindowGroupLimit below the shuffle, so each task ships ≤ n rows
    per variable.
    """
    from pyspark.sql import Window

    keys = list(order_by)
    knn = [c for c, m in model.methods.items() if m == "knn"]
    source, after = df, {c: model.fill_expr(c, df) for c, m in model.methods.items() if m != "knn"}
    if knn:  # the neighbours' values come from the filled table, joined back by the row key
        done = model.transform(df).select(*[col(k) for k in keys], *[col(c).alias(f"_after_{i}") for i, c in enumerate(knn)])
        source = df.join(done, keys)
        after |= {c: F.col(f"_after_{i}") for i, c in enumerate(knn)}
    if not model.methods:
        raise ImputePlanError("nothing to preview")
    changed = []
    for c, m in model.methods.items():
        is_text = m == "mode" and not is_numeric(model.types[c])
        changed.append(F.when(missing_cond(df, c), F.struct(
            F.lit(c).alias("variable"), F.lit(m).alias("method"), F.lit("NA").alias("before"),
            (F.lit(None).cast("double") if is_text else after[c].cast("double")).alias("after_value"),
            (after[c].cast("string") if is_text else F.lit(None).cast("string")).alias("after_label"))))
    # One scan for all columns; a row gives one line for each of its missing values.
    allp = (source.select(*map(col, keys), F.explode(F.array_compact(F.array(*changed))).alias("_c"))
            .select("_c.variable", "_c.method", *map(col, keys), "_c.before", "_c.after_value", "_c.after_label"))
    w = Window.partitionBy("variable").orderBy(*map(col, keys))
    return allp.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")
