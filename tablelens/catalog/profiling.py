"""B and C keys: projections, predicates, profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import columns as cols
from ..operators import profile as prof
from ..registry import register
from .sqlgen import D, clean_sql, missing_sql, rint2, union_all

LI_KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
LI_KEYS_SQL = ", ".join(LI_KEYS)
LINEITEM_NUMERIC = [("l_orderkey", False), ("l_partkey", False), ("l_suppkey", False),
                    ("l_linenumber", False), ("l_quantity", True), ("l_extendedprice", True),
                    ("l_discount", True), ("l_tax", True)]
LINEITEM_TYPES = [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"),
                  ("l_linenumber", "int"), ("l_quantity", "double"), ("l_extendedprice", "double"),
                  ("l_discount", "double"), ("l_tax", "double"), ("l_returnflag", "string"),
                  ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz")]
ROLE = {"bigint": "quantitative", "int": "quantitative", "double": "quantitative",
        "string": "qualitative", "timestamp": "temporal", "timestamp_ntz": "temporal"}
LM = fx.LINEITEM_MISSING_SQL


def _values(rows: list[tuple], names: str) -> str:
    def lit(v):
        return f"'{v}'" if isinstance(v, str) else str(v)
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({names})"


# ------------------------------------------------------------------ B keys
@register("search_columns", "SELECT l_extendedprice, l_tax FROM lineitem", ["l_extendedprice", "l_tax"])
def q_search_columns(spark, sf):
    return cols.search_columns(fx.table(spark, sf, "lineitem"), "PRICE|tax")


def _present_sql(rows: list[tuple], names: str) -> str:
    """The typed list of ``lineitem_missing``'s columns with each one's count of present values."""
    counts = union_all([f"SELECT '{c}' AS variable, count({c}) AS present FROM {LM} AS m" for c, _ in LINEITEM_TYPES])
    return f"SELECT t.*, c.present FROM ({_values(rows, names)}) AS t JOIN ({counts}) AS c USING (variable)"


@register("column_roles", _present_sql([(c, t, ROLE[t]) for c, t in LINEITEM_TYPES], "variable, dtype, role"))
def q_column_roles(spark, sf):
    return cols.column_roles(fx.lineitem_missing(spark, sf), counts=True)


@register("schema_report", _present_sql([(i + 1, c, t) for i, (c, t) in enumerate(LINEITEM_TYPES)], "position, variable, dtype"))
def q_schema_report(spark, sf):
    return cols.schema_report(fx.lineitem_missing(spark, sf), counts=True)


_FLOATS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _round_floats_sql() -> str:
    parts = []
    for c in _FLOATS:
        frac = f"(SELECT bool_or({c} <> floor({c})) FROM lineitem)"
        parts.append(f"CASE WHEN {frac} THEN {rint2(c)} ELSE {c} END AS {c}")
    return f"SELECT {LI_KEYS_SQL}, {', '.join(parts)} FROM lineitem"


@register("round_floats", _round_floats_sql(), _FLOATS)
def q_round_floats(spark, sf):
    return cols.round_floats(fx.table(spark, sf, "lineitem").select(*LI_KEYS, *_FLOATS), 2)


_LM_ALL = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, " \
          "l_tax, l_returnflag, l_linestatus, l_shipdate"
_LM_FLOATS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("drop_missing_any",
          f"SELECT {_LM_ALL} FROM {LM} AS m WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL "
          f"AND l_returnflag IS NOT NULL", _LM_FLOATS)
def q_drop_missing_any(spark, sf):
    return cols.drop_missing(fx.lineitem_missing(spark, sf))


@register("drop_missing_subset",
          f"SELECT {_LM_ALL} FROM {LM} AS m WHERE l_quantity IS NOT NULL AND l_returnflag IS NOT NULL",
          _LM_FLOATS)
def q_drop_missing_subset(spark, sf):
    return cols.drop_missing(fx.lineitem_missing(spark, sf), ["l_quantity", "l_returnflag"])


@register("select_rows",
          "SELECT doc_id, text, lang, source, n_chars FROM documents "
          "WHERE doc_id IN (SELECT doc_id FROM labels)")
def q_select_rows(spark, sf):
    return cols.select_rows(fx.table(spark, sf, "documents"), "doc_id", fx.table(spark, sf, "labels"))


@register("preview",
          f"SELECT * FROM lineitem ORDER BY {LI_KEYS_SQL} LIMIT 10", _LM_FLOATS)
def q_preview(spark, sf):
    return cols.preview(fx.table(spark, sf, "lineitem"), 10, LI_KEYS)


@register("to_numeric_coerce",
          f"SELECT p_partkey, TRY_CAST(p_size AS DOUBLE) AS p_size_num FROM {fx.PART_TEXT_SQL} AS p",
          ["p_size_num"])
def q_to_numeric(spark, sf):
    p = fx.part_text(spark, sf)
    return p.select("p_partkey", cols.to_numeric("p_size").alias("p_size_num"))


@register("nan_to_null",
          f"SELECT {LI_KEYS_SQL}, CASE WHEN isnan(l_tax) THEN NULL ELSE l_tax END AS l_tax "
          f"FROM {fx.LINEITEM_NAN_SQL} AS n", ["l_tax"])
def q_nan_to_null(spark, sf):
    return cols.nan_to_null(fx.lineitem_nan(spark, sf).select(*LI_KEYS, "l_tax"))


@register("value_share",
          "SELECT count(*) FILTER (WHERE l_returnflag = 'R') AS matches, count(*) AS rows, "
          "CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS DOUBLE) * 100 / count(*) AS pct "
          f"FROM {LM} AS m", ["pct"])
def q_value_share(spark, sf):
    return cols.value_share(fx.lineitem_missing(spark, sf), "l_returnflag", "R")


# ------------------------------------------------------------------ C keys
def _describe_numeric_sql(source: str, columns: list[tuple[str, bool]]) -> str:
    parts = []
    for c, is_float in columns:
        x = clean_sql(c, is_float)
        parts.append(
            f"SELECT '{c}' AS variable, count({x}) AS count, avg({x}) AS mean, "
            f"stddev_samp({x}) AS std, min({x}) AS min, quantile_cont({x}, 0.25) AS q25, "
            f"quantile_cont({x}, 0.5) AS q50, quantile_cont({x}, 0.75) AS q75, max({x}) AS max, "
            f"{missing_sql(c, is_float)} AS missing FROM {source}")
    return union_all(parts)


_DESC_FLOATS = ["mean", "std", "min", "q25", "q50", "q75", "max"]


@register("describe_numeric", _describe_numeric_sql("lineitem", LINEITEM_NUMERIC), _DESC_FLOATS)
def q_describe_numeric(spark, sf):
    return prof.describe_numeric(fx.table(spark, sf, "lineitem"))


@register("describe_numeric_missing",
          _describe_numeric_sql(f"{LM} AS m", [("l_quantity", True), ("l_discount", True),
                                               ("l_extendedprice", True)]), _DESC_FLOATS)
def q_describe_numeric_missing(spark, sf):
    return prof.describe_numeric(fx.lineitem_missing(spark, sf),
                                 ["l_quantity", "l_discount", "l_extendedprice"])


@register("describe_numeric_nan",
          _describe_numeric_sql(f"{fx.LINEITEM_NAN_SQL} AS n", [("l_tax", True)]), _DESC_FLOATS)
def q_describe_numeric_nan(spark, sf):
    return prof.describe_numeric(fx.lineitem_nan(spark, sf), ["l_tax"])


_APPROX = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("describe_numeric_approx", union_all([
    f"SELECT '{c}' AS variable, count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min, max({c}) AS max, "
    f"true AS q25_ok, true AS q50_ok, true AS q75_ok FROM lineitem" for c in _APPROX]), ["mean", "std", "min", "max"])
def q_describe_numeric_approx(spark, sf):
    """Approximate quartiles are held against the data: the rank of each is within a thousandth of what it should be."""
    li = fx.table(spark, sf, "lineitem")
    out = prof.describe_numeric(li, _APPROX, exact=False)
    q = {r["variable"]: r for r in out.collect()}
    ranks = li.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c) <= F.lit(q[c][k])).alias(f"{c}_{k}_upto") for c in _APPROX for k in ("q25", "q50", "q75")],
                   *[F.count_if(F.col(c) < F.lit(q[c][k])).alias(f"{c}_{k}_below") for c in _APPROX for k in ("q25", "q50", "q75")]).first()
    ok = {}
    for c in _APPROX:
        for k, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)):
            ok[c, k] = ranks[f"{c}_{k}_below"] <= (p + 0.001) * ranks["n"] and ranks[f"{c}_{k}_upto"] >= (p - 0.001) * ranks["n"]
    flags = spark.createDataFrame([(c, ok[c, "q25"], ok[c, "q50"], ok[c, "q75"]) for c in _APPROX],
                                  "variable string, q25_ok boolean, q50_ok boolean, q75_ok boolean")
    return out.join(F.broadcast(flags), "variable").select("variable", "count", "mean", "std", "min", "max", "q25_ok", "q50_ok", "q75_ok")


def _cat_counts_sql(source: str, c: str) -> str:
    return f"(SELECT CAST({c} AS VARCHAR) AS v, count(*) AS cnt FROM {source} GROUP BY 1)"


def _describe_categorical_sql(source: str, columns: list[str]) -> str:
    parts = []
    for c in columns:
        cc = _cat_counts_sql(source, c)
        parts.append(
            f"SELECT '{c}' AS variable, "
            f"CAST(coalesce(sum(cnt) FILTER (WHERE v IS NOT NULL), 0) AS BIGINT) AS count, "
            f"count(v) AS unique, "
            f"(SELECT v FROM {cc} AS t WHERE v IS NOT NULL ORDER BY cnt DESC, v LIMIT 1) AS top, "
            f"max(cnt) FILTER (WHERE v IS NOT NULL) AS freq, "
            f"CAST(coalesce(sum(cnt) FILTER (WHERE v IS NULL), 0) AS BIGINT) AS missing FROM {cc} AS c")
    return union_all(parts)


@register("describe_categorical",
          _describe_categorical_sql(f"{LM} AS m", ["l_returnflag", "l_linestatus"]))
def q_describe_categorical(spark, sf):
    return prof.describe_categorical(fx.lineitem_missing(spark, sf))


@register("describe_categorical_documents",
          _describe_categorical_sql("documents", ["text", "lang", "source"]))
def q_describe_categorical_documents(spark, sf):
    return prof.describe_categorical(fx.table(spark, sf, "documents"))


_LM_TYPES = [("l_orderkey", "bigint", False), ("l_partkey", "bigint", False),
             ("l_suppkey", "bigint", False), ("l_linenumber", "int", False),
             ("l_quantity", "double", True), ("l_extendedprice", "double", True),
             ("l_discount", "double", True), ("l_tax", "double", True),
             ("l_returnflag", "string", False), ("l_linestatus", "string", False),
             ("l_shipdate", "timestamp_ntz", False)]


def _missing_long_sql(source: str) -> str:
    parts = [f"SELECT '{c}' AS variable, '{t}' AS dtype, '{ROLE[t]}' AS role, "
             f"{missing_sql(c, f)} AS missing, count(*) AS rows FROM {source}" for c, t, f in _LM_TYPES]
    return union_all(parts)


@register("missing_report",
          f"SELECT variable, missing, {rint2(f'{D('missing')} / {D('rows')} * 100')} AS pct, dtype "
          f"FROM ({_missing_long_sql(f'{LM} AS m')}) AS t WHERE missing > 0", ["pct"])
def q_missing_report(spark, sf):
    return prof.missing_report(fx.lineitem_missing(spark, sf))


@register("missing_columns",
          f"SELECT variable, role, missing FROM ({_missing_long_sql(f'{LM} AS m')}) AS t WHERE missing > 0")
def q_missing_columns(spark, sf):
    return prof.missing_columns(fx.lineitem_missing(spark, sf))


def _mode_sql(source: str, columns: list[str]) -> str:
    parts = []
    for c in columns:
        cc = _cat_counts_sql(source, c)
        parts.append(
            f"SELECT '{c}' AS variable, v AS mode, cnt AS freq, "
            f"{D('cnt')} / (SELECT count(*) FROM {source}) * 100 AS pct "
            f"FROM (SELECT v, cnt FROM {cc} AS t WHERE v IS NOT NULL ORDER BY cnt DESC, v LIMIT 1) AS m")
    return union_all(parts)


@register("mode_report", _mode_sql(f"{LM} AS m", ["l_returnflag", "l_linestatus"]), ["pct"])
def q_mode_report(spark, sf):
    return prof.mode_report(fx.lineitem_missing(spark, sf), ["l_returnflag", "l_linestatus"])


@register("mode_report_orders", _mode_sql("orders", ["o_orderstatus", "o_orderpriority"]), ["pct"])
def q_mode_report_orders(spark, sf):
    return prof.mode_report(fx.table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"])


@register("duplicate_count",
          "SELECT CAST(sum(c) AS BIGINT) AS rows, count(*) AS distinct_rows, "
          "CAST(sum(c) - count(*) AS BIGINT) AS duplicates "
          "FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber) AS g")
def q_duplicate_count(spark, sf):
    return prof.duplicate_count(fx.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@register("row_count", "SELECT count(*) AS rows FROM lineitem")
def q_row_count(spark, sf):
    return prof.row_count(fx.table(spark, sf, "lineitem"))


_POSITIONS = [0, 1, 10, 100, 1000, 10000]


@register("select_positions",
          "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM "
          "(SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders) AS t "
          f"WHERE pos IN ({', '.join(map(str, _POSITIONS))})", ["o_totalprice"])
def q_select_positions(spark, sf):
    return cols.select_positions(fx.table(spark, sf, "orders"), "o_orderkey", _POSITIONS)


@register("preview_page",
          "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM "
          "(SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders) AS t "
          "WHERE pos >= 30 AND pos < 40", ["o_totalprice"])
def q_preview_page(spark, sf):
    return cols.page(fx.table(spark, sf, "orders"), 3, 10, "o_orderkey")
