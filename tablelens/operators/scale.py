"""F — normalisation: adds ``{var}_norm`` and keeps the original column.

Fit parameters come from one aggregate (plus the R1 quantile plan for the
robust scaler) and are applied as literals, so the transform is a single
projection that also works on streaming frames. Every divisor is guarded.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.fit import clean_value, col, one_row
from ..plans.quantiles import exact_quantiles_refined

SCALERS = ("standard", "minmax", "robust", "log")


@dataclass
class ScaleModel:
    var: str
    method: str
    center: float = 0.0
    scale: float = 1.0
    suffix: str = "_norm"

    @property
    def out_col(self) -> str:
        return f"{self.var}{self.suffix}"

    def expr(self, source: DataFrame) -> Column:
        x = clean_value(source, self.var).cast("double")
        if self.method == "log":
            return F.log1p(F.when(x > -1.0, x))
        return (x - F.lit(self.center)) / F.lit(self.scale)

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.out_col, self.expr(df))


def fit_scaler(df: DataFrame, var: str, method: str, suffix: str = "_norm") -> ScaleModel:
    if method not in SCALERS:
        raise ValueError(f"unknown method {method!r}; expected one of {SCALERS}")
    x = clean_value(df, var).cast("double")
    if method == "log":
        return ScaleModel(var, method, suffix=suffix)
    if method == "standard":
        r = one_row(df.agg(F.avg(x).alias("c"), F.stddev_pop(x).alias("s")))
        center, scale = r["c"], r["s"]
    elif method == "minmax":
        r = one_row(df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")))
        center = r["lo"]
        scale = None if r["lo"] is None else r["hi"] - r["lo"]
    else:
        rows = exact_quantiles_refined(df.select(x.alias("_x")), "_x", [0.25, 0.5, 0.75]).collect()
        q = (rows[0]["q"] if rows else None) or []
        center, scale = (q[1], q[2] - q[0]) if len(q) == 3 and None not in q else (None, None)
    if center is None:
        center = 0.0
    if scale is None or scale == 0:
        scale = 1.0
    return ScaleModel(var, method, float(center), float(scale), suffix)


def normalize(df: DataFrame, var: str, method: str = "standard", suffix: str = "_norm") -> DataFrame:
    """Standard (ddof=0), min-max, robust (median/IQR) or log1p."""
    return fit_scaler(df, var, method, suffix).transform(df)


def normalize_report(df: DataFrame, var: str, method: str = "standard") -> DataFrame:
    """statistic, original, normalized for min, max, mean, std (ddof=1)."""
    model = fit_scaler(df, var, method)
    out = model.transform(df)
    a = clean_value(out, var).cast("double")
    b = col(model.out_col)
    stats = out.agg(F.min(a).alias("o_min"), F.max(a).alias("o_max"),
                    F.avg(a).alias("o_mean"), F.stddev_samp(a).alias("o_std"),
                    F.min(b).alias("n_min"), F.max(b).alias("n_max"),
                    F.avg(b).alias("n_mean"), F.stddev_samp(b).alias("n_std"))
    return stats.select(F.explode(F.array(*[
        F.struct(F.lit(s).alias("statistic"), F.col(f"o_{s}").alias("original"),
                 F.col(f"n_{s}").alias("normalized"))
        for s in ("min", "max", "mean", "std")])).alias("r")).select("r.*")


def normalize_preview_hist(df: DataFrame, var: str, method: str = "standard", bins: int = 30) -> DataFrame:
    """30-bin histograms of the original and the normalised column (long form).

    After the fit one pass gets both ranges and one both sets of counts.
    """
    from .charts import histograms
    model = fit_scaler(df, var, method)
    return histograms(df, {"original": clean_value(df, var).cast("double"), "normalized": model.expr(df)}, bins)
