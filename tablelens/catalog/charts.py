"""H keys: chart-ready aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions.normal import ppnd_sql
from ..operators import charts as ch
from ..registry import register
from .cleaning import hist_sql
from .sqlgen import D, union_all

LM = fx.LINEITEM_MISSING_SQL


@register("value_counts",
          "SELECT o_orderpriority, count(*) AS count FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1")
def q_value_counts(spark, sf):
    return ch.value_counts(fx.table(spark, sf, "orders"), "o_orderpriority")


@register("value_counts_by",
          "SELECT o_orderstatus, o_orderpriority, count(*) AS count FROM orders "
          "WHERE o_orderpriority IS NOT NULL AND o_orderstatus IS NOT NULL GROUP BY 1, 2")
def q_value_counts_by(spark, sf):
    return ch.value_counts(fx.table(spark, sf, "orders"), "o_orderpriority", by="o_orderstatus")


@register("value_shares",
          "SELECT c_mktsegment, count(*) AS count, CAST(count(*) AS DOUBLE) / "
          "(SELECT count(c_mktsegment) FROM customer) * 100 AS pct FROM customer "
          "WHERE c_mktsegment IS NOT NULL GROUP BY 1", ["pct"])
def q_value_shares(spark, sf):
    return ch.value_shares(fx.table(spark, sf, "customer"), "c_mktsegment")


@register("histogram", hist_sql("events", "value", 5), ["lower", "upper"])
def q_histogram(spark, sf):
    return ch.histogram(fx.table(spark, sf, "events"), "value", 5)


@register("histogram_20", hist_sql("lineitem", "l_extendedprice", 20), ["lower", "upper"])
def q_histogram_20(spark, sf):
    return ch.histogram(fx.table(spark, sf, "lineitem"), "l_extendedprice", 20)


@register("density_histogram", hist_sql("events", "value", 30, density=True),
          ["lower", "upper", "density"], digits=9)
def q_density_histogram(spark, sf):
    return ch.density_histogram(fx.table(spark, sf, "events"), "value", 30)


def box_sql(src: str, var: str, by: str | None = None, label: str | None = None) -> str:
    """DuckDB twin of charts.box_stats; ``label`` names the group column in the output."""
    g = f"{by}" if by else "0"
    gsel = f'g AS "{label or by}", ' if by else ""
    return (
        f"WITH x AS (SELECT {g} AS g, CAST({var} AS DOUBLE) AS v FROM {src} WHERE {var} IS NOT NULL), "
        f"q AS (SELECT g, count(*) AS n, avg(v) AS mean, stddev_samp(v) AS std, quantile_cont(v, 0.25) AS q1, "
        f"quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM x GROUP BY g), "
        f"f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence FROM q) "
        f"SELECT {gsel}f.n, f.mean, f.std, f.q1, f.median, f.q3, f.lower_fence, f.upper_fence, "
        f"min(v) FILTER (WHERE v >= lower_fence AND v <= upper_fence) AS whisker_low, "
        f"max(v) FILTER (WHERE v >= lower_fence AND v <= upper_fence) AS whisker_high, "
        f"count(*) FILTER (WHERE v < lower_fence OR v > upper_fence) AS outliers, "
        f"f.median - 1.57 * (f.q3 - f.q1) / sqrt(f.n) AS notch_low, "
        f"f.median + 1.57 * (f.q3 - f.q1) / sqrt(f.n) AS notch_high "
        f"FROM f JOIN x USING (g) GROUP BY ALL")


_BOX_FLOATS = ["mean", "std", "q1", "median", "q3", "lower_fence", "upper_fence", "whisker_low",
               "whisker_high", "notch_low", "notch_high"]


@register("box_stats", box_sql("events", "value"), _BOX_FLOATS)
def q_box_stats(spark, sf):
    return ch.box_stats(fx.table(spark, sf, "events"), "value")


@register("box_outliers",
          "WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events) "
          "SELECT value FROM events, q WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)",
          ["value"])
def q_box_outliers(spark, sf):
    return ch.box_outliers(fx.table(spark, sf, "events"), "value")


@register("grouped_box", box_sql("events", "value", by="event_type", label="group"), _BOX_FLOATS)
def q_grouped_box(spark, sf):
    return ch.grouped_box(fx.table(spark, sf, "events"), "event_type", "value")


_PT = fx.PART_TEXT_SQL


@register("grouped_mean",
          f"SELECT coalesce(p_size, 'None') AS \"group\", avg(TRY_CAST(p_retailprice AS DOUBLE)) AS mean, "
          f"stddev_samp(TRY_CAST(p_retailprice AS DOUBLE)) AS std, count(*) AS count FROM {_PT} AS p "
          f"WHERE TRY_CAST(p_retailprice AS DOUBLE) IS NOT NULL GROUP BY 1", ["mean", "std"])
def q_grouped_mean(spark, sf):
    return ch.grouped_mean(fx.part_text(spark, sf), "p_size", "p_retailprice")


@register("strip_points",
          "SELECT coalesce(c_mktsegment, 'None') AS \"group\", c_acctbal AS value, "
          "avg(c_acctbal) OVER (PARTITION BY coalesce(c_mktsegment, 'None')) AS group_mean "
          "FROM customer WHERE c_acctbal IS NOT NULL", ["value", "group_mean"])
def q_strip_points(spark, sf):
    return ch.strip_points(fx.table(spark, sf, "customer"), "c_mktsegment", "c_acctbal")


@register("scatter_points",
          f"SELECT l_quantity, l_extendedprice, l_discount FROM {LM} AS m WHERE l_quantity IS NOT NULL "
          f"AND l_extendedprice IS NOT NULL AND l_discount IS NOT NULL",
          ["l_quantity", "l_extendedprice", "l_discount"])
def q_scatter_points(spark, sf):
    return ch.scatter_points(fx.lineitem_missing(spark, sf), ["l_quantity", "l_extendedprice", "l_discount"])


_CORR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "k"]


def _corr_sql() -> str:
    src = (f"(SELECT l_quantity, l_extendedprice, l_discount, l_tax, CAST(5.0 AS DOUBLE) AS k FROM {LM} AS m "
           f"WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL) AS t")
    parts = []
    for i, a in enumerate(_CORR_COLS):
        for b in _CORR_COLS:
            if a == b:
                r = f"CASE WHEN stddev_samp({a}) > 0 THEN CAST(1 AS DOUBLE) END"
            else:
                den = f"(stddev_samp({a}) * stddev_samp({b}))"
                r = f"CASE WHEN {den} > 0 THEN covar_samp({a}, {b}) / {den} END"
            parts.append(f"SELECT '{a}' AS var_x, '{b}' AS var_y, {r} AS r FROM {src}")
    return union_all(parts)


@register("correlation_matrix", _corr_sql(), ["r"])
def q_correlation_matrix(spark, sf):
    df = fx.lineitem_missing(spark, sf).withColumn("k", F.lit(5.0))
    return ch.correlation_matrix(df, _CORR_COLS)


def _grid_sql(points: int = 100) -> str:
    return (f"g AS (SELECT CAST(range AS INTEGER) AS i, CASE WHEN range = {points - 1} THEN hi "
            f"ELSE CAST(range AS DOUBLE) * ((hi - lo) / {points - 1}) + lo END AS x FROM range({points}), s)")


@register("kde",
          "WITH s AS (SELECT min(value) AS lo, max(value) AS hi, count(value) AS n, stddev_samp(value) AS sd, "
          "stddev_samp(value) * pow(CAST(count(value) AS DOUBLE), -0.2) AS h FROM events), "
          f"{_grid_sql()}, c AS (SELECT value AS v, count(*) AS c FROM events WHERE value IS NOT NULL GROUP BY 1) "
          "SELECT i, x, sum(c.c * exp(-((x - v) * (x - v)) / (2 * h * h))) / (n * h * sqrt(2 * pi())) AS density "
          "FROM g, c, s GROUP BY i, x, n, h", ["x", "density"], digits=9)
def q_kde(spark, sf):
    return ch.kde(fx.table(spark, sf, "events"), "value")


@register("normal_curve",
          "WITH s AS (SELECT min(value) AS lo, max(value) AS hi, avg(value) AS mu, stddev_pop(value) AS sd "
          f"FROM events), {_grid_sql()} "
          "SELECT i, x, exp(-((x - mu) / sd) * ((x - mu) / sd) / 2.0) / (sd * 2.5066282746310002) AS density "
          "FROM g, s", ["x", "density"], digits=9)
def q_normal_curve(spark, sf):
    return ch.normal_curve(fx.table(spark, sf, "events"), "value")


_QQ_P = ("CASE WHEN n = 1 THEN CAST(0.01 AS DOUBLE) WHEN pos = n THEN CAST(0.99 AS DOUBLE) "
         "ELSE CAST(pos - 1 AS DOUBLE) * (CAST(0.98 AS DOUBLE) / CAST(n - 1 AS DOUBLE)) + CAST(0.01 AS DOUBLE) END")


@register("qq_points",
          "WITH r AS (SELECT value, row_number() OVER (ORDER BY value) AS pos, count(*) OVER () AS n "
          "FROM events WHERE value IS NOT NULL) "
          f"SELECT pos, {ppnd_sql(_QQ_P)} AS theoretical, value AS observed FROM r",
          ["theoretical", "observed"])
def q_qq_points(spark, sf):
    return ch.qq_points(fx.table(spark, sf, "events"), "value")


@register("qq_reference_line",
          f"SELECT {ppnd_sql('0.01')} AS x0, {ppnd_sql('0.99')} AS x1, {ppnd_sql('0.01')} AS y0, "
          f"{ppnd_sql('0.99')} AS y1 FROM (SELECT count(value) AS n FROM events) AS t WHERE n > 1",
          ["x0", "x1", "y0", "y1"])
def q_qq_reference_line(spark, sf):
    return ch.qq_reference_line(fx.table(spark, sf, "events"), "value")


def _dist_sql(by: str | None) -> str:
    g = f"{by} AS {by}, " if by else ""
    grp = f" GROUP BY {by}" if by else ""
    return (f"SELECT {g}count(value) AS n, avg(value) AS mean, quantile_cont(value, 0.5) AS median, "
            f"stddev_samp(value) AS std, skewness(value) AS skewness, kurtosis(value) AS kurtosis "
            f"FROM events WHERE value IS NOT NULL{grp}")


_DIST_FLOATS = ["mean", "median", "std", "skewness", "kurtosis"]


@register("distribution_summary", _dist_sql(None), _DIST_FLOATS)
def q_distribution_summary(spark, sf):
    return ch.distribution_summary(fx.table(spark, sf, "events"), "value")


@register("distribution_summary_by", _dist_sql("event_type"), _DIST_FLOATS)
def q_distribution_summary_by(spark, sf):
    return ch.distribution_summary(fx.table(spark, sf, "events"), "value", by="event_type")
