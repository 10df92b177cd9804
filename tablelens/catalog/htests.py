"""I keys: hypothesis tests.

``<test>`` keys carry the statistic; ``<test>_full`` keys add the p-value and
verdict. DuckDB has no tail functions, so the twins sum them up: Student's t by
the finite trigonometric series for whole degrees of freedom (the normal limit
otherwise, for Welch's many), χ² by the series of the incomplete gamma
function, Kolmogorov by its alternating series, Shapiro by Royston's normal
transform — other methods than the library's continued fractions.
"""

from __future__ import annotations

from .. import fixtures as fx
from ..functions.normal import norm_cdf_sql, ppnd_sql
from ..functions.tails import _SW_C1, _SW_C2, _SW_C5, _SW_C6
from ..operators import htests as ht
from ..registry import register

LM = fx.LINEITEM_MISSING_SQL
_LM_NOT_NULL = "l_quantity IS NOT NULL AND l_discount IS NOT NULL AND l_returnflag IS NOT NULL"


def _t_p_sql(t: str, dof: str) -> str:
    """Two-sided p of Student's t as SQL text over columns ``t`` and ``dof``."""
    cos2, sine = f"({dof} / ({dof} + {t} * {t}))", f"sqrt({t} * {t} / ({dof} + {t} * {t}))"
    even = (f"1 - {sine} * list_sum(list_transform(range(0, CAST({dof} / 2 AS BIGINT)), "
            f"lambda j: exp(lgamma(j + 0.5) - lgamma(j + 1.0) - 0.5 * ln(pi()) + j * ln({cos2}))))")
    odd = (f"1 - 2 / pi() * (atan(abs({t}) / sqrt({dof})) + {sine} * sqrt({cos2}) * coalesce(list_sum(list_transform("
           f"range(0, CAST(({dof} - 1) / 2 AS BIGINT)), lambda j: exp(2 * j * ln(2.0) + 2 * lgamma(j + 1.0) "
           f"- lgamma(2 * j + 2.0) + j * ln({cos2})))), 0))")
    z = f"(abs({t}) * (1 - 1 / (4 * {dof})) / sqrt(1 + {t} * {t} / (2 * {dof})))"
    limit = f"2 * {norm_cdf_sql('-' + z)}"
    return (f"(CASE WHEN {t} IS NULL THEN NULL WHEN isinf({t}) THEN 0.0 WHEN {dof} <> floor({dof}) THEN {limit} "
            f"WHEN CAST({dof} AS BIGINT) % 2 = 0 THEN {even} ELSE {odd} END)")


def _chi2_p_sql(x: str, dof: str) -> str:
    a, h = f"({dof} / 2.0)", f"({x} / 2.0)"
    return (f"(CASE WHEN {dof} = 0 OR {x} <= 0 THEN 1.0 ELSE 1 - list_sum(list_transform(range(0, 3000), "
            f"lambda k: exp(({a} + k) * ln({h}) - {h} - lgamma({a} + k + 1.0)))) END)")


def _ks_p_sql(d: str, n: str) -> str:
    lam = f"((sqrt({n}) + 0.12 + 0.11 / sqrt({n})) * {d})"
    return (f"greatest(0.0, least(1.0, 2 * list_sum(list_transform(range(1, 200), "
            f"lambda k: (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * k * k * {lam} * {lam})))))")


def _verdict_sql(p: str, small: str, otherwise: str) -> str:
    return f"CASE WHEN {p} IS NULL THEN 'undetermined' WHEN {p} < 0.05 THEN '{small}' ELSE '{otherwise}' END"


def _with_p(inner: str, p: str, small: str, otherwise: str, extra: str = "") -> str:
    """``inner``'s columns, the p-value and its verdict."""
    return (f"SELECT *, {_verdict_sql('p_value', small, otherwise)} AS verdict{extra} "
            f"FROM (SELECT *, {p} AS p_value FROM ({inner}) AS s) AS q")


def _poly_sql(coefs: list[float], x: str) -> str:
    return " + ".join(f"{c!r} * pow({x}, {i})" for i, c in enumerate(coefs))


def _shapiro_sql() -> str:
    m = ppnd_sql("(CAST(pos AS DOUBLE) - 0.375) / (CAST(n AS DOUBLE) + 0.25)")
    return (
        "WITH x AS (SELECT event_type AS g, value AS v FROM events WHERE value IS NOT NULL), "
        "r AS (SELECT g, v, row_number() OVER (PARTITION BY g ORDER BY v) AS pos, "
        "count(*) OVER (PARTITION BY g) AS n FROM x), "
        f"m AS (SELECT g, v, pos, n, {m} AS m FROM r), "
        "s AS (SELECT g, max(n) AS n, sum(m * m) AS sum_m2, sum(m * v) AS sum_mx, "
        "max(CASE WHEN pos = n THEN m END) AS m_n, max(CASE WHEN pos = n - 1 THEN m END) AS m_n1, "
        "max(CASE WHEN pos = 1 THEN v END) AS x_1, max(CASE WHEN pos = 2 THEN v END) AS x_2, "
        "max(CASE WHEN pos = n - 1 THEN v END) AS x_n1, max(CASE WHEN pos = n THEN v END) AS x_n "
        "FROM m GROUP BY g), "
        "q AS (SELECT g, var_pop(v) * count(v) AS ssq FROM x GROUP BY g), "
        "a AS (SELECT s.*, q.ssq, "
        f"m_n / sqrt(sum_m2) + ({_poly_sql(_SW_C1, '1 / sqrt(CAST(n AS DOUBLE))')}) AS a_n, "
        f"m_n1 / sqrt(sum_m2) + ({_poly_sql(_SW_C2, '1 / sqrt(CAST(n AS DOUBLE))')}) AS a_n1 "
        "FROM s JOIN q USING (g)), "
        "f AS (SELECT *, (sum_m2 - 2 * m_n * m_n - 2 * m_n1 * m_n1) / (1 - 2 * a_n * a_n - 2 * a_n1 * a_n1) "
        "AS phi FROM a) "
        "SELECT g AS event_type, n, least(pow((sum_mx - m_n * (x_n - x_1) - m_n1 * (x_n1 - x_2)) / sqrt(phi) "
        "+ a_n * (x_n - x_1) + a_n1 * (x_n1 - x_2), 2) / ssq, 1.0) AS w FROM f")


@register("shapiro", _shapiro_sql(), ["w"])
def q_shapiro(spark, sf):
    return ht.shapiro(fx.table(spark, sf, "events"), "value", by="event_type").select("event_type", "n", "w")


def _shapiro_p_sql() -> str:
    y = (f"((ln(1 - w) - ({_poly_sql(_SW_C5, 'ln(n)')})) / exp({_poly_sql(_SW_C6, 'ln(n)')}))")
    return f"1 - {norm_cdf_sql(y)}"  # groups of more than 11 values


@register("shapiro_full", _with_p(_shapiro_sql(), _shapiro_p_sql(), "not normal", "normal",
                                  ", n >= 3 AND n <= 5000 AS p_reliable"), ["w", "p_value"])
def q_shapiro_full(spark, sf):
    return ht.shapiro(fx.table(spark, sf, "events"), "value", by="event_type")


def _ks_sql() -> str:
    cdf = norm_cdf_sql("(v - mu) / sd")
    return (
        "WITH x AS (SELECT l_extendedprice AS v FROM lineitem WHERE l_extendedprice IS NOT NULL), "
        "s AS (SELECT avg(v) AS mu, stddev_samp(v) AS sd, count(v) AS n FROM x), "
        "c AS (SELECT v, count(*) AS cnt FROM x GROUP BY v), "
        "o AS (SELECT v, cnt, coalesce(sum(cnt) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND "
        "1 PRECEDING), 0) AS below FROM c), "
        f"f AS (SELECT o.*, s.n, {cdf} AS F FROM o, s) "
        "SELECT max(n) AS n, max(greatest(CAST(below + cnt AS DOUBLE) / CAST(n AS DOUBLE) - F, "
        "F - CAST(below AS DOUBLE) / CAST(n AS DOUBLE))) AS statistic FROM f")


@register("ks_normal", _ks_sql(), ["statistic"])
def q_ks_normal(spark, sf):
    return ht.ks_normal(fx.table(spark, sf, "lineitem"), "l_extendedprice").select("n", "statistic")


@register("ks_normal_full", _with_p(_ks_sql(), _ks_p_sql("statistic", "n"), "not normal", "normal"), ["statistic", "p_value"])
def q_ks_normal_full(spark, sf):
    return ht.ks_normal(fx.table(spark, sf, "lineitem"), "l_extendedprice")


def _corr_sql(src: str, x: str, y: str) -> str:
    den = f"(stddev_samp({x}) * stddev_samp({y}))"
    return (f"WITH c AS (SELECT count(*) AS n, CASE WHEN {den} > 0 THEN covar_samp({x}, {y}) / {den} END AS r "
            f"FROM {src}) SELECT n, r, CASE WHEN n > 2 THEN CASE WHEN abs(r) < 1 THEN "
            f"r * sqrt(CAST(n - 2 AS DOUBLE) / (1 - r * r)) ELSE sign(r) * CAST('inf' AS DOUBLE) END END AS t_stat "
            f"FROM c")


@register("pearson",
          _corr_sql(f"(SELECT * FROM {LM} AS m WHERE {_LM_NOT_NULL}) AS t", "l_quantity", "l_extendedprice"),
          ["r", "t_stat"])
def q_pearson(spark, sf):
    return ht.pearson(fx.lineitem_missing(spark, sf), "l_quantity", "l_extendedprice").select("n", "r", "t_stat")


@register("pearson_full",
          _with_p(_corr_sql(f"(SELECT * FROM {LM} AS m WHERE {_LM_NOT_NULL}) AS t", "l_quantity", "l_extendedprice"),
                  _t_p_sql("t_stat", "CAST(n - 2 AS DOUBLE)"), "significant", "not significant"), ["r", "t_stat", "p_value"])
def q_pearson_full(spark, sf):
    return ht.pearson(fx.lineitem_missing(spark, sf), "l_quantity", "l_extendedprice")


def _spearman_src(x: str, y: str) -> str:
    rk = lambda c: (f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0)")
    return f"(SELECT CAST({rk(x)} AS DOUBLE) AS rx, CAST({rk(y)} AS DOUBLE) AS ry FROM lineitem) AS t"


@register("spearman", _corr_sql(_spearman_src("l_quantity", "l_discount"), "rx", "ry"), ["r", "t_stat"])
def q_spearman(spark, sf):
    return ht.spearman(fx.table(spark, sf, "lineitem"), "l_quantity", "l_discount").select("n", "r", "t_stat")


@register("spearman_full",
          _with_p(_corr_sql(_spearman_src("l_quantity", "l_discount"), "rx", "ry"),
                  _t_p_sql("t_stat", "CAST(n - 2 AS DOUBLE)"), "significant", "not significant"), ["r", "t_stat", "p_value"])
def q_spearman_full(spark, sf):
    return ht.spearman(fx.table(spark, sf, "lineitem"), "l_quantity", "l_discount")


def _chi2_sql(src: str, a: str, b: str) -> str:
    return (
        f"WITH o AS (SELECT CAST({a} AS VARCHAR) AS a, CAST({b} AS VARCHAR) AS b, count(*) AS o FROM {src} "
        f"WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2), "
        "r AS (SELECT a, sum(o) AS r FROM o GROUP BY a), c AS (SELECT b, sum(o) AS c FROM o GROUP BY b), "
        "t AS (SELECT sum(o) AS n, (SELECT count(*) FROM r) AS nr, (SELECT count(*) FROM c) AS nc FROM o), "
        "e AS (SELECT o.o, CAST(r.r AS DOUBLE) * CAST(c.c AS DOUBLE) / CAST(t.n AS DOUBLE) AS e, "
        "(t.nr - 1) * (t.nc - 1) AS dof FROM o JOIN r USING (a) JOIN c USING (b), t) "
        "SELECT CAST((SELECT n FROM t) AS BIGINT) AS n, CAST(max(dof) AS BIGINT) AS dof, "
        "CASE WHEN max(dof) = 0 THEN CAST(0 AS DOUBLE) WHEN max(dof) = 1 THEN "
        "sum(pow(abs(o - e) - least(0.5, abs(o - e)), 2) / e) ELSE sum((o - e) * (o - e) / e) END AS chi2, "
        "max(dof) = 1 AS yates FROM e")


@register("chi2", _chi2_sql("lineitem", "l_returnflag", "l_linestatus"), ["chi2"])
def q_chi2(spark, sf):
    return ht.chi2(fx.table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus").select(
        "n", "dof", "chi2", "yates")


@register("chi2_yates", _chi2_sql("labels", "quality", "toxic"), ["chi2"])
def q_chi2_yates(spark, sf):
    return ht.chi2(fx.table(spark, sf, "labels"), "quality", "toxic").select("n", "dof", "chi2", "yates")


@register("chi2_full", _with_p(_chi2_sql("labels", "quality", "toxic"), _chi2_p_sql("chi2", "dof"), "dependent", "independent"),
          ["chi2", "p_value"])
def q_chi2_full(spark, sf):
    return ht.chi2(fx.table(spark, sf, "labels"), "quality", "toxic")


@register("chi2_table_full",
          _with_p(_chi2_sql("orders", "o_orderpriority", "o_orderstatus"), _chi2_p_sql("chi2", "dof"), "dependent", "independent"),
          ["chi2", "p_value"])
def q_chi2_table_full(spark, sf):
    return ht.chi2(fx.table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus")


@register("contingency",
          "SELECT l_returnflag, l_linestatus, count(*) AS count FROM lineitem "
          "WHERE l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL GROUP BY 1, 2")
def q_contingency(spark, sf):
    return ht.contingency(fx.table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")


@register("contingency_wide",
          "SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'F') AS \"F\", "
          "count(*) FILTER (WHERE l_linestatus = 'O') AS \"O\" FROM lineitem "
          "WHERE l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL GROUP BY 1")
def q_contingency_wide(spark, sf):
    return ht.contingency_wide(fx.table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")


def _t_sql(equal_var: bool) -> str:
    if equal_var:
        dof = "CAST(n1 + n2 - 2 AS DOUBLE)"
        se = (f"sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / {dof} * (1.0 / n1 + 1.0 / n2))")
    else:
        dof = ("(v1 / n1 + v2 / n2) * (v1 / n1 + v2 / n2) / ((v1 / n1) * (v1 / n1) / (n1 - 1) + "
               "(v2 / n2) * (v2 / n2) / (n2 - 1))")
        se = "sqrt(v1 / n1 + v2 / n2)"
    return (
        "WITH g AS (SELECT l_linestatus AS c, count(*) AS n, avg(l_extendedprice) AS m, "
        "var_samp(l_extendedprice) AS v FROM lineitem WHERE l_linestatus IS NOT NULL GROUP BY 1), "
        "p AS (SELECT a.c AS group_1, b.c AS group_2, a.n AS n_1, b.n AS n_2, a.m AS mean_1, b.m AS mean_2, "
        "CAST(a.n AS DOUBLE) AS n1, CAST(b.n AS DOUBLE) AS n2, a.v AS v1, b.v AS v2 "
        "FROM g AS a JOIN g AS b ON a.c < b.c) "
        f"SELECT group_1, group_2, n_1, n_2, mean_1, mean_2, (mean_1 - mean_2) / {se} AS t_stat, "
        f"{dof} AS dof, 'ok' AS status FROM p")


_T_FLOATS = ["mean_1", "mean_2", "t_stat", "dof"]
_T_COLS = ["group_1", "group_2", "n_1", "n_2", "mean_1", "mean_2", "t_stat", "dof", "status"]


@register("t_test", _t_sql(True), _T_FLOATS)
def q_t_test(spark, sf):
    return ht.t_test(fx.table(spark, sf, "lineitem"), "l_linestatus", "l_extendedprice").select(*_T_COLS)


@register("t_test_welch", _t_sql(False), _T_FLOATS)
def q_t_test_welch(spark, sf):
    return ht.t_test(fx.table(spark, sf, "lineitem"), "l_linestatus", "l_extendedprice",
                     equal_var=False).select(*_T_COLS)


@register("t_test_full", _with_p(_t_sql(True), _t_p_sql("t_stat", "dof"), "significant", "not significant"), [*_T_FLOATS, "p_value"])
def q_t_test_full(spark, sf):
    return ht.t_test(fx.table(spark, sf, "lineitem"), "l_linestatus", "l_extendedprice")


@register("t_test_welch_full", _with_p(_t_sql(False), _t_p_sql("t_stat", "dof"), "significant", "not significant"), [*_T_FLOATS, "p_value"])
def q_t_test_welch_full(spark, sf):
    return ht.t_test(fx.table(spark, sf, "lineitem"), "l_linestatus", "l_extendedprice", equal_var=False)


def _t_by_sql() -> str:
    dof, se = "CAST(n1 + n2 - 2 AS DOUBLE)", "sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2))"
    inner = (
        "WITH g AS (SELECT l_returnflag AS b, l_linestatus AS c, count(*) AS n, avg(l_extendedprice) AS m, "
        "var_samp(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2) "
        "SELECT l_returnflag, group_1, group_2, n_1, n_2, mean_1, mean_2, "
        f"(mean_1 - mean_2) / {se} AS t_stat, {dof} AS dof, 'ok' AS status FROM (SELECT a.b AS l_returnflag, a.c AS group_1, "
        "b.c AS group_2, a.n AS n_1, b.n AS n_2, a.m AS mean_1, b.m AS mean_2, CAST(a.n AS DOUBLE) AS n1, CAST(b.n AS DOUBLE) AS n2, "
        "a.v AS v1, b.v AS v2 FROM g AS a JOIN g AS b ON a.b = b.b AND a.c < b.c) AS p")
    return _with_p(inner, _t_p_sql("t_stat", "dof"), "significant", "not significant")


@register("t_test_by", _t_by_sql(), [*_T_FLOATS, "p_value"])
def q_t_test_by(spark, sf):
    return ht.t_test(fx.table(spark, sf, "lineitem"), "l_linestatus", "l_extendedprice", by="l_returnflag")


# ----------------------------------------------------------- grouped (by=) variants
@register("pearson_by",
          "SELECT o_orderpriority, count(*) AS n, CASE WHEN stddev_samp(x) * stddev_samp(y) > 0 THEN "
          "covar_samp(x, y) / (stddev_samp(x) * stddev_samp(y)) END AS r FROM "
          "(SELECT o_orderpriority, CAST(o_orderkey AS DOUBLE) AS x, o_totalprice AS y FROM orders) AS t "
          "GROUP BY o_orderpriority", ["r"])
def q_pearson_by(spark, sf):
    o = fx.table(spark, sf, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return ht.pearson(o, "o_orderkey", "o_totalprice", by="o_orderpriority").select("o_orderpriority", "n", "r")


@register("chi2_by",
          "WITH o AS (SELECT o_orderstatus AS g, o_orderpriority AS a, CAST(o_custkey % 3 AS VARCHAR) AS b, "
          "count(*) AS o FROM orders GROUP BY 1, 2, 3), "
          "r AS (SELECT g, a, sum(o) AS r FROM o GROUP BY g, a), c AS (SELECT g, b, sum(o) AS c FROM o GROUP BY g, b), "
          "t AS (SELECT g, sum(o) AS n, count(DISTINCT a) AS nr, count(DISTINCT b) AS nc FROM o GROUP BY g), "
          "e AS (SELECT o.g, o.o, CAST(r.r AS DOUBLE) * CAST(c.c AS DOUBLE) / CAST(t.n AS DOUBLE) AS e, "
          "(t.nr - 1) * (t.nc - 1) AS dof, t.n FROM o JOIN r USING (g, a) JOIN c USING (g, b) JOIN t USING (g)) "
          "SELECT g AS o_orderstatus, CAST(max(n) AS BIGINT) AS n, CAST(max(dof) AS BIGINT) AS dof, "
          "CASE WHEN max(dof) = 0 THEN CAST(0 AS DOUBLE) WHEN max(dof) = 1 THEN "
          "sum(pow(abs(o - e) - least(0.5, abs(o - e)), 2) / e) ELSE sum((o - e) * (o - e) / e) END AS chi2 "
          "FROM e GROUP BY g", ["chi2"])
def q_chi2_by(spark, sf):
    from pyspark.sql import functions as F
    o = fx.table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority",
                                             (F.col("o_custkey") % 3).cast("string").alias("bucket"))
    return ht.chi2(o, "o_orderpriority", "bucket", by="o_orderstatus").select("o_orderstatus", "n", "dof", "chi2")


@register("ks_normal_by",
          "WITH x AS (SELECT event_type AS g, value AS v FROM events WHERE value IS NOT NULL), "
          "s AS (SELECT g, avg(v) AS mu, stddev_samp(v) AS sd, count(v) AS n FROM x GROUP BY g), "
          "c AS (SELECT g, v, count(*) AS cnt FROM x GROUP BY g, v), "
          "o AS (SELECT g, v, cnt, coalesce(sum(cnt) OVER (PARTITION BY g ORDER BY v ROWS BETWEEN UNBOUNDED "
          "PRECEDING AND 1 PRECEDING), 0) AS below FROM c), "
          f"f AS (SELECT o.*, s.n, {norm_cdf_sql('(v - mu) / sd')} AS F FROM o JOIN s USING (g)) "
          "SELECT g AS event_type, max(n) AS n, max(greatest(CAST(below + cnt AS DOUBLE) / CAST(n AS DOUBLE) - F, "
          "F - CAST(below AS DOUBLE) / CAST(n AS DOUBLE))) AS statistic FROM f GROUP BY g", ["statistic"])
def q_ks_normal_by(spark, sf):
    return ht.ks_normal(fx.table(spark, sf, "events"), "value", by="event_type").select("event_type", "n", "statistic")


@register("spearman_by",
          "WITH x AS (SELECT event_type AS g, CAST(user_id AS DOUBLE) AS a, value AS b FROM events), "
          "k AS (SELECT g, CAST(rank() OVER (PARTITION BY g ORDER BY a) + (count(*) OVER (PARTITION BY g, a) - 1) "
          "/ 2.0 AS DOUBLE) AS rx, CAST(rank() OVER (PARTITION BY g ORDER BY b) + (count(*) OVER (PARTITION BY g, b) "
          "- 1) / 2.0 AS DOUBLE) AS ry FROM x) "
          "SELECT g AS event_type, count(*) AS n, CASE WHEN stddev_samp(rx) * stddev_samp(ry) > 0 THEN "
          "covar_samp(rx, ry) / (stddev_samp(rx) * stddev_samp(ry)) END AS r FROM k GROUP BY g", ["r"])
def q_spearman_by(spark, sf):
    ev = fx.table(spark, sf, "events").select("event_type", "user_id", "value")
    return ht.spearman(ev, "user_id", "value", by="event_type").select("event_type", "n", "r")


@register("pearson_odd_names",
          f"SELECT l_returnflag AS \"flag.of `row`\", CAST(count(*) AS BIGINT) AS n, corr(l_quantity, l_extendedprice) AS r FROM {LM} AS m "
          "WHERE l_quantity IS NOT NULL AND l_returnflag IS NOT NULL GROUP BY 1", ["r"])
def q_pearson_odd_names(spark, sf):
    """Column names with dots, spaces and back quotes, listwise over the columns used."""
    names = {"l_quantity": "Sepal.Length", "l_extendedprice": "a b", "l_returnflag": "flag.of `row`"}
    df = fx.lineitem_missing(spark, sf).withColumnsRenamed(names)
    return ht.pearson(df, "Sepal.Length", "a b", by="flag.of `row`", listwise="used").select("`flag.of ``row```", "n", "r")
