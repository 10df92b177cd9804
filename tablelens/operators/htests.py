"""I — hypothesis tests, whole-table or one row per group (``by=``).

Each test reduces the data to sufficient statistics with Spark aggregates
(moments, contingency cells, distinct-value offsets from the R1 plan); only
the final p-value is computed in Python, by a ``pandas_udf`` over the
aggregated frame (one row per group).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normal import norm_cdf_col, ppnd_col
from ..functions.tails import chi2_p_udf, ks_p_udf, shapiro_udf, t_p_udf
from ..plans.fit import attach, clean_value, col, materialize, plain_names, safe_div
from ..plans.ranks import keyed_offsets, sorted_positions, with_ranks
from .columns import drop_missing, group_label

ALPHA = 0.05
SHAPIRO_MAX_RELIABLE_N = 5000


def verdict(p: Column, alpha: float, when_small: str, otherwise: str) -> Column:
    """Label from a p-value; without one the test is 'undetermined'."""
    return F.when(p.isNull() | F.isnan(p), F.lit("undetermined")).when(p < F.lit(alpha), F.lit(when_small)).otherwise(F.lit(otherwise))


def _keyed(df: DataFrame, cols: Sequence[str], by: str | None) -> tuple[DataFrame, list[str]]:
    key = [group_label(by).alias(by)] if by else [F.lit(0).alias("_g")]
    src = df.select(*key, *[clean_value(df, c).cast("double").alias(c) for c in cols])
    return src, [by] if by else ["_g"]


def _out(frame: DataFrame, by: str | None, cols: list) -> DataFrame:
    return frame.select(*([by] if by else []), *cols)


# --------------------------------------------------------------------- I1
@plain_names("var", "by", out=["by"])
def shapiro(df: DataFrame, var: str, by: str | None = None, alpha: float = ALPHA) -> DataFrame:
    """N, w, p_value, verdict ('normal' when p > alpha), p_reliable (3 ≤ n ≤ 5000).

    The sorted sample is rebuilt from distinct-value offsets (R1), each
    position gets mᵢ = Φ⁻¹((i−.375)/(n+.25)) natively, and one aggregate per
    group yields the sums the Royston weights need.
    """
    src, keys = _keyed(df, [var], by)
    src = src.where(F.col(var).isNotNull())
    pos = sorted_positions(keyed_offsets(src, var, keys, bool(by)), keys)
    m = ppnd_col((F.col("pos") - F.lit(0.375)) / (F.col("n") + F.lit(0.25)))
    pos = pos.withColumn("m", m)
    at = lambda k, c: F.max(F.when(F.col("pos") == k, F.col(c)))
    sums = pos.groupBy(*keys).agg(
        F.max("n").alias("n"), F.sum(F.col("m") * F.col("m")).alias("sum_m2"),
        F.sum(F.col("m") * F.col("value")).alias("sum_mx"),
        at(F.col("n"), "m").alias("m_n"), at(F.col("n") - 1, "m").alias("m_n1"),
        at(F.lit(1), "value").alias("x_1"), at(F.lit(2), "value").alias("x_2"),
        at(F.col("n") - 1, "value").alias("x_n1"), at(F.col("n"), "value").alias("x_n"))
    ssq = src.groupBy(*keys).agg((F.var_pop(var) * F.count(var)).alias("ssq"))
    joined = attach(sums, ssq, keys, bool(by), broadcast=False)
    res = joined.withColumn("_r", shapiro_udf("n", "sum_m2", "sum_mx", "m_n", "m_n1",
                                              "x_1", "x_2", "x_n1", "x_n", "ssq"))
    p = F.col("_r.p_value")
    return _out(res, by, ["n", F.col("_r.w").alias("w"), p.alias("p_value"),
                          verdict(p, alpha, "not normal", "normal").alias("verdict"),
                          ((F.col("n") >= 3) & (F.col("n") <= SHAPIRO_MAX_RELIABLE_N)).alias("p_reliable")])


# --------------------------------------------------------------------- I2
@plain_names("var", "by", out=["by"])
def ks_statistic(df: DataFrame, var: str, by: str | None = None) -> DataFrame:
    """D of the one-sample KS test against N(0,1) after standardising with the
    sample mean and ddof=1 std. Uses only distinct values and their offsets:
    D⁺ = (below+cnt)/n − Φ(z), D⁻ = Φ(z) − below/n."""
    src, keys = _keyed(df, [var], by)
    src = src.where(F.col(var).isNotNull())
    stats = src.groupBy(*keys).agg(F.avg(var).alias("mean"), F.stddev_samp(var).alias("sd"))
    off = attach(keyed_offsets(src, var, keys, bool(by)), stats, keys, bool(by))
    cdf = norm_cdf_col((F.col("value") - F.col("mean")) / F.col("sd"))
    d = F.greatest((F.col("below") + F.col("cnt")) / F.col("n") - cdf, cdf - F.col("below") / F.col("n"))
    return off.groupBy(*keys).agg(F.max("n").alias("n"), F.max(d).alias("statistic"))


@plain_names("var", "by", out=["by"])
def ks_normal(df: DataFrame, var: str, by: str | None = None, alpha: float = ALPHA) -> DataFrame:
    """N, statistic, p_value, verdict ('normal' when p > alpha)."""
    st = ks_statistic(df, var, by)
    p = ks_p_udf("statistic", "n")
    res = st.withColumn("p_value", p)
    return _out(res, by, ["n", "statistic", "p_value",
                          verdict(F.col("p_value"), alpha, "not normal", "normal").alias("verdict")])


# --------------------------------------------------------------------- I3/I4
def _listwise(df: DataFrame, x: str, y: str, listwise: str, extra: Sequence[str] = ()) -> DataFrame:
    if listwise == "all":
        return drop_missing(df)
    if listwise == "used":
        return drop_missing(df, [x, y, *extra])
    raise ValueError("listwise must be 'all' (reference behaviour) or 'used'")


def _pearson_from(src: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    den = F.stddev_samp(x) * F.stddev_samp(y)
    return src.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"),
                                  F.when(den > 0, F.covar_samp(x, y) / den).alias("r"))


def _corr_result(stats: DataFrame, by: str | None, alpha: float) -> DataFrame:
    n, r = F.col("n"), F.col("r")
    t = F.when(F.abs(r) < 1, r * F.sqrt((n - 2) / (F.lit(1.0) - r * r))) \
        .otherwise(F.signum(r) * F.lit(float("inf")))
    res = stats.withColumn("t_stat", F.when(n > 2, t)).withColumn(
        "p_value", F.when(F.col("t_stat").isNotNull(), t_p_udf(F.col("t_stat"), (n - 2).cast("double"))))
    return _out(res, by, ["n", "r", "t_stat", "p_value",
                          verdict(F.col("p_value"), alpha, "significant", "not significant").alias("verdict")])


@plain_names("x", "y", "by", out=["by"])
def pearson(df: DataFrame, x: str, y: str, by: str | None = None, listwise: str = "all",
            alpha: float = ALPHA) -> DataFrame:
    """N, r, t_stat, p_value (two-sided t with n−2 dof), verdict.

    ``listwise='all'`` drops rows with a null anywhere (reference behaviour);
    ``'used'`` only looks at x, y (and the group key).
    """
    base = _listwise(df, x, y, listwise, [by] if by else [])
    src, keys = _keyed(base, [x, y], by)
    src = src.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return _corr_result(_pearson_from(src, keys, x, y), by, alpha)


@plain_names("x", "y", "by", out=["by"])
def spearman(df: DataFrame, x: str, y: str, by: str | None = None, listwise: str = "all",
             alpha: float = ALPHA) -> DataFrame:
    """I4: Pearson on average ranks (ties averaged), both columns ranked in one R1 plan (see :func:`.ranks.with_ranks`)."""
    base = _listwise(df, x, y, listwise, [by] if by else [])
    src, keys = _keyed(base, [x, y], by)
    src = src.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return _corr_result(_pearson_from(with_ranks(src, [x, y], keys), keys, "_r0", "_r1"), by, alpha)


# --------------------------------------------------------------------- I5/I6
@plain_names("a", "b", "by", out=["a", "b", "by"])
def contingency(df: DataFrame, a: str, b: str, by: str | None = None) -> DataFrame:
    """I6 (long form): observed (a, b, count) cells; pairs with a null dropped."""
    keys = [by] if by else []
    return (df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
            .groupBy(*keys, a, b).agg(F.count(F.lit(1)).alias("count")))


@plain_names("a", "b", out=["a"])
def contingency_wide(df: DataFrame, a: str, b: str, max_levels: int = 1000) -> DataFrame:
    """I6 (display form): one row per level of ``a``, one column per level of ``b``.

    The column levels are collected first and bounded by ``max_levels``.
    """
    from ..plans.fit import collect_bounded
    levels = [r[0] for r in collect_bounded(
        df.where(F.col(b).isNotNull()).select(b).distinct().orderBy(b), max_levels)]
    cells = contingency(df, a, b)
    wide = cells.groupBy(a).pivot(b, levels).agg(F.first("count")).orderBy(a)
    return wide.select(a, *[F.coalesce(col(c), F.lit(0)).alias(c) for c in wide.columns if c != a])


@plain_names("a", "b", "by", out=["by"])
def chi2_statistic(df: DataFrame, a: str, b: str, by: str | None = None,
                   yates: bool = True) -> DataFrame:
    """χ² of independence from observed cells only (no level × level product).

    Without correction χ² = Σ_obs O²/E − n. With Yates (applied when dof = 1,
    i.e. a 2×2 table) every cell has the same |O−E| = |d|, so
    χ² = max(0, |d|−½)² · n · Σ1/rᵢ · Σ1/cⱼ, with d taken from the first cell.
    """
    keys = [by] if by else ["_g"]
    base = df.select(*([group_label(by).alias(by)] if by else [F.lit(0).alias("_g")]),
                     F.col(a).cast("string").alias("_a"), F.col(b).cast("string").alias("_b"))
    cells = (base.where(F.col("_a").isNotNull() & F.col("_b").isNotNull())
             .groupBy(*keys, "_a", "_b").agg(F.count(F.lit(1)).alias("o")))
    cells = materialize(cells)  # the only pass over the data; all below reads the cells
    rows = cells.groupBy(*keys, "_a").agg(F.sum("o").alias("r"))
    cols = cells.groupBy(*keys, "_b").agg(F.sum("o").alias("c"))
    rstat = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("r").alias("n"),
                                    F.sum(F.lit(1.0) / F.col("r")).alias("inv_r"),
                                    F.min(F.struct("_a", "r")).alias("_fa"))
    cstat = cols.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_cols"),
                                    F.sum(F.lit(1.0) / F.col("c")).alias("inv_c"),
                                    F.min(F.struct("_b", "c")).alias("_fb"))
    cellstats = (cells.join(rows, [*keys, "_a"]).join(cols, [*keys, "_b"])
                 .groupBy(*keys).agg(F.sum(F.col("o") * F.col("o") / (F.col("r") * F.col("c"))).alias("s_rc"),
                                     F.min(F.struct("_a", "_b", "o")).alias("_m")))
    grouped = bool(by)
    rflat = rstat.select(*keys, "n_rows", "n", "inv_r", F.col("_fa.r").alias("r1"))
    cflat = cstat.select(*keys, "n_cols", "inv_c", F.col("_fb._b").alias("b1"), F.col("_fb.c").alias("c1"))
    st = attach(attach(cellstats, rflat, keys, grouped, broadcast=False), cflat, keys, grouped, broadcast=False)
    st = st.withColumn("o11", F.when(F.col("_m._b") == F.col("b1"), F.col("_m.o")).otherwise(F.lit(0)))
    st = st.withColumn("s", F.col("s_rc") * F.col("n"))
    dof = (F.col("n_rows") - 1) * (F.col("n_cols") - 1)
    plain = F.col("s") - F.col("n")
    d = F.abs(F.col("o11") - F.col("r1") * F.col("c1") / F.col("n"))
    corrected = F.pow(F.greatest(d - F.lit(0.5), F.lit(0.0)), 2) * F.col("n") * F.col("inv_r") * F.col("inv_c")
    use_yates = F.lit(bool(yates)) & (dof == 1)
    chi2 = F.when(dof == 0, F.lit(0.0)).when(use_yates, corrected).otherwise(F.greatest(plain, F.lit(0.0)))
    return st.select(*keys, F.col("n").cast("long").alias("n"), dof.cast("long").alias("dof"),
                     chi2.alias("chi2"), use_yates.alias("yates"))


@plain_names("a", "b", "by", out=["by"])
def chi2(df: DataFrame, a: str, b: str, by: str | None = None, yates: bool = True,
         alpha: float = ALPHA) -> DataFrame:
    """N, dof, chi2, yates, p_value, verdict ('dependent' when p < alpha)."""
    st = chi2_statistic(df, a, b, by, yates)
    res = st.withColumn("p_value", F.when(F.col("dof") == 0, F.lit(1.0))
                        .otherwise(chi2_p_udf(F.col("chi2"), F.col("dof").cast("double"))))
    return _out(res, by, ["n", "dof", "chi2", "yates", "p_value",
                          verdict(F.col("p_value"), alpha, "dependent", "independent").alias("verdict")])


# --------------------------------------------------------------------- I7/I8
@plain_names("cat", "num", "by", "order_key", out=["by"])
def t_statistic(df: DataFrame, cat: str, num: str, by: str | None = None, equal_var: bool = True,
                listwise: str = "all", order_key: str | None = None) -> DataFrame:
    """Two-sample t statistic from per-group (n, mean, var).

    Groups are ordered by label, or by first appearance (smallest ``order_key``)
    when given — the order sets the sign of t. ``status`` is 'ok' or an error
    when the key does not have exactly two groups.
    """
    base = _listwise(df, cat, num, listwise, [by] if by else [])
    keys = [by] if by else ["_g"]
    src = base.select(*([group_label(by).alias(by)] if by else [F.lit(0).alias("_g")]),
                      F.col(cat).cast("string").alias("_c"), clean_value(base, num).cast("double").alias("_x"),
                      (F.col(order_key) if order_key else F.lit(0)).alias("_o"))
    src = src.where(F.col("_c").isNotNull() & F.col("_x").isNotNull())
    g = src.groupBy(*keys, "_c").agg(F.count(F.lit(1)).alias("n"), F.avg("_x").alias("mean"),
                                     F.var_samp("_x").alias("var"), F.min("_o").alias("_first"))
    two = g.groupBy(*keys).agg(F.count(F.lit(1)).alias("k"),
                               F.min(F.struct("_first", "_c", "n", "mean", "var")).alias("g1"),
                               F.max(F.struct("_first", "_c", "n", "mean", "var")).alias("g2"))
    n1, n2 = F.col("g1.n").cast("double"), F.col("g2.n").cast("double")
    v1, v2 = F.col("g1.var"), F.col("g2.var")
    diff = F.col("g1.mean") - F.col("g2.mean")
    if equal_var:
        dof = n1 + n2 - 2
        sp2 = ((n1 - 1) * v1 + (n2 - 1) * v2) / dof
        se = F.sqrt(sp2 * (F.lit(1.0) / n1 + F.lit(1.0) / n2))
    else:
        a1, a2 = v1 / n1, v2 / n2
        se = F.sqrt(a1 + a2)
        dof = safe_div((a1 + a2) * (a1 + a2), a1 * a1 / (n1 - 1) + a2 * a2 / (n2 - 1))
    ok = F.col("k") == 2
    # Two constant groups: an infinite t if they differ, none if they don't.
    t = F.when(ok & (se > 0), diff / se).when(ok & (se == 0) & (diff != 0), F.signum(diff) * F.lit(float("inf")))
    return two.select(*keys,
                      F.col("g1._c").alias("group_1"), F.col("g2._c").alias("group_2"),
                      F.col("g1.n").alias("n_1"), F.col("g2.n").alias("n_2"),
                      F.col("g1.mean").alias("mean_1"), F.col("g2.mean").alias("mean_2"),
                      t.alias("t_stat"), F.when(ok, dof).alias("dof"),
                      F.when(ok, F.lit("ok")).otherwise(F.lit("needs exactly 2 groups")).alias("status"))


@plain_names("cat", "num", "by", "order_key", out=["by"])
def t_test(df: DataFrame, cat: str, num: str, by: str | None = None, equal_var: bool = True,
           listwise: str = "all", alpha: float = ALPHA, order_key: str | None = None) -> DataFrame:
    """I7 (pooled, ``equal_var=True``) / I8 (Welch): two-sided p and verdict."""
    st = t_statistic(df, cat, num, by, equal_var, listwise, order_key)
    p = F.when(F.abs("t_stat") == float("inf"), 0.0).when(F.col("t_stat").isNotNull(), t_p_udf(F.col("t_stat"), F.col("dof")))
    res = st.withColumn("p_value", p)
    return _out(res, by, ["group_1", "group_2", "n_1", "n_2", "mean_1", "mean_2", "t_stat", "dof",
                          "p_value", verdict(F.col("p_value"), alpha, "significant", "not significant")
                          .alias("verdict"), "status"])
