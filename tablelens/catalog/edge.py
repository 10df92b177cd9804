"""Keys for inputs that the clean tables don't reach: odd text, 64-bit and NULL keys, NaN,
missing groups, empty tables, samples. All derive from whole driver tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import charts as ch
from ..operators import columns as cols
from ..operators import htests as ht
from ..operators import scale as sc
from ..operators.impute import impute, validate_plan
from ..registry import register
from ..sources.delimited import ingest, read_csv
from ..sources.export import ExportError, export_csv
from .sources import _scratch

# Keys beyond 2^53 apart by one, a tenth of them NULL.
_BIG = (1 << 53) + 1


def _hash_keyed(spark, sf: str) -> DataFrame:
    o = fx.table(spark, sf, "orders")
    key = F.when(F.col("o_orderkey") % 10 != 0, F.lit(_BIG) + F.col("o_orderkey"))
    return o.select(key.alias("k"), "o_orderkey", "o_totalprice")


_HASH_KEYED_SQL = (f"(SELECT CASE WHEN o_orderkey % 10 <> 0 THEN {_BIG} + o_orderkey END AS k, o_orderkey, o_totalprice "
                   "FROM orders) AS h")


@register("page_big_keys", f"SELECT * FROM {_HASH_KEYED_SQL} ORDER BY k NULLS FIRST, o_orderkey, o_totalprice LIMIT 500 OFFSET 1000",
          ["o_totalprice"])
def q_page_big_keys(spark, sf):
    return cols.page(_hash_keyed(spark, sf), 2, 500, "k")


@register("page_text_key", "SELECT o_orderstatus, o_orderkey FROM orders ORDER BY 1, 2 LIMIT 40 OFFSET 200")
def q_page_text_key(spark, sf):
    return cols.page(fx.table(spark, sf, "orders").select("o_orderstatus", "o_orderkey"), 5, 40, "o_orderstatus")


@register("page_index", "SELECT k, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY k NULLS FIRST, o_orderkey, o_totalprice) - 1 AS p "
          f"FROM {_HASH_KEYED_SQL}) AS r WHERE p BETWEEN 1400 AND 1439", ["o_totalprice"])
def q_page_index(spark, sf):
    return cols.PositionIndex(_hash_keyed(spark, sf), "k").page(35, 40)


_AT = [0, 1, 150, 1499, 1500, 9_000_000]


@register("select_positions_big_keys",
          f"SELECT k, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY k NULLS FIRST, o_orderkey, o_totalprice) - 1 AS p "
          f"FROM {_HASH_KEYED_SQL}) AS r WHERE p IN ({', '.join(map(str, _AT))})", ["o_totalprice"])
def q_select_positions_big_keys(spark, sf):
    return cols.select_positions(_hash_keyed(spark, sf), "k", _AT)


@register("strip_points_sample",
          "SELECT \"group\", value, group_mean FROM (SELECT c_custkey, c_mktsegment AS \"group\", c_acctbal AS value, "
          "avg(c_acctbal) OVER (PARTITION BY c_mktsegment) AS group_mean FROM customer) AS s "
          "ORDER BY md5('42|' || c_custkey), c_custkey LIMIT 333", ["value", "group_mean"])
def q_strip_points_sample(spark, sf):
    return ch.strip_points(fx.table(spark, sf, "customer"), "c_mktsegment", "c_acctbal", max_points=333, row_key=["c_custkey"])


@register("scatter_points_sample",
          "SELECT o_totalprice, CAST(o_custkey AS DOUBLE) AS o_custkey FROM orders ORDER BY md5('7|' || o_orderkey), o_orderkey LIMIT 777",
          ["o_totalprice", "o_custkey"])
def q_scatter_points_sample(spark, sf):
    return ch.scatter_points(fx.table(spark, sf, "orders"), ["o_totalprice", "o_custkey"], max_points=777, seed=7, row_key=["o_orderkey"])


def _odd_documents(spark, sf: str) -> DataFrame:
    d = fx.table(spark, sf, "documents")
    return d.select("doc_id", F.concat(F.lit('He said "no", twice:\n '), F.col("text"), F.lit(' "')).alias("text"),
                    F.concat(F.col("doc_id").cast("string"), F.lit("D")).alias("code"), F.col("lang").alias("lang.code"))


_ODD_DOCUMENTS_SQL = ("SELECT doc_id, 'He said \"no\", twice:' || chr(10) || ' ' || text || ' \"' AS text, doc_id || 'D' AS code, "
                      "lang AS \"lang.code\" FROM documents")


@register("ingest_csv_text", _ODD_DOCUMENTS_SQL)
def q_ingest_csv_text(spark, sf):
    path = _scratch(spark, "csv") + "/documents.csv"
    (_odd_documents(spark, sf).write.option("header", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return ingest(spark, path)


@register("export_roundtrip_text", _ODD_DOCUMENTS_SQL)
def q_export_roundtrip_text(spark, sf):
    return read_csv(spark, export_csv(_odd_documents(spark, sf), _scratch(spark, "export"), "odd_documents"))


@register("export_empty_refused", "SELECT 'orders' AS source, count(*) FILTER (WHERE o_orderkey < 0) = 0 AS refused FROM orders")
def q_export_empty_refused(spark, sf):
    """An export of no rows is an error."""
    try:
        export_csv(fx.table(spark, sf, "orders").where("o_orderkey < 0"), _scratch(spark, "export"), "nothing")
        refused = False
    except ExportError:
        refused = True
    return spark.createDataFrame([("orders", refused)], "source string, refused boolean")


def _missing_group(spark, sf: str) -> DataFrame:
    c = fx.table(spark, sf, "customer")
    return c.select(F.when(F.col("c_custkey") % 6 != 0, F.col("c_mktsegment")).alias("seg"), "c_acctbal")


@register("grouped_mean_none",
          "SELECT coalesce(CASE WHEN c_custkey % 6 <> 0 THEN c_mktsegment END, 'None') AS \"group\", avg(c_acctbal) AS mean, "
          "stddev_samp(c_acctbal) AS std, count(*) AS count FROM customer GROUP BY 1", ["mean", "std"])
def q_grouped_mean_none(spark, sf):
    return ch.grouped_mean(_missing_group(spark, sf), "seg", "c_acctbal")


@register("impute_plan_untreated",
          "SELECT c AS variable FROM (SELECT count(l_discount) AS d, count(l_returnflag) AS f, count(*) AS n FROM "
          f"{fx.LINEITEM_MISSING_SQL} AS m) AS t, (VALUES ('l_discount'), ('l_returnflag')) AS v(c) "
          "WHERE (c = 'l_discount' AND d < n) OR (c = 'l_returnflag' AND f < n)")
def q_impute_plan_untreated(spark, sf):
    """Columns with missing values that the plan leaves out."""
    found = validate_plan(fx.lineitem_missing(spark, sf), mean=["l_quantity"])["untreated"]
    return spark.createDataFrame([(c,) for c in found], "variable string")


_GUARDED = ("histogram", "box_stats", "box_outliers", "grouped_box", "kde", "qq_points", "value_counts", "strip_points", "normalize_robust")


@register("empty_guards",
          "SELECT what, CAST(n AS BIGINT) AS rows_out FROM (SELECT count(*) AS n FROM customer WHERE c_custkey < 0) AS e, "
          f"(VALUES {', '.join(repr((w,)).replace(',', '') for w in _GUARDED)}) AS v(what)")
def q_empty_guards(spark, sf):
    """Every chart of an empty selection is an empty frame, not an error."""
    none = fx.table(spark, sf, "customer").where("c_custkey < 0")
    x, g = "c_acctbal", "c_mktsegment"
    made = {"histogram": ch.histogram(none, x), "box_stats": ch.box_stats(none, x), "box_outliers": ch.box_outliers(none, x),
            "grouped_box": ch.grouped_box(none, g, x), "kde": ch.kde(none, x), "qq_points": ch.qq_points(none, x),
            "value_counts": ch.value_counts(none, g), "strip_points": ch.strip_points(none, g, x),
            "normalize_robust": sc.normalize(none, x, "robust")}
    return spark.createDataFrame([(w, made[w].count()) for w in _GUARDED], "what string, rows_out long")


@register("box_stats_all_null", "SELECT count(l_quantity) AS n, 0 AS boxes, 0 AS outliers FROM "
          "(SELECT CASE WHEN l_linenumber < 0 THEN l_quantity END AS l_quantity FROM lineitem) AS t")
def q_box_stats_all_null(spark, sf):
    df = fx.table(spark, sf, "lineitem").select(F.when(F.col("l_linenumber") < 0, F.col("l_quantity")).alias("l_quantity"))
    n = df.agg(F.count("l_quantity")).first()[0]
    return spark.createDataFrame([(n, ch.box_stats(df, "l_quantity").count(), ch.box_outliers(df, "l_quantity").count())],
                                 "n long, boxes int, outliers int")


def _nan_customers(spark, sf: str) -> DataFrame:
    c = fx.table(spark, sf, "customer")
    nan = F.lit(float("nan"))
    return c.select("c_custkey", F.when(F.col("c_custkey") % 9 == 0, nan).otherwise(F.col("c_acctbal")).alias("bal"),
                    F.when(F.col("c_custkey") % 7 == 0, nan).otherwise(F.col("c_nationkey").cast("double")).alias("nat"))


@register("impute_knn_nan", """
WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 9 <> 0 THEN c_acctbal END AS bal,
                  CASE WHEN c_custkey % 7 <> 0 THEN CAST(c_nationkey AS DOUBLE) END AS nat FROM customer),
d AS (SELECT r.c_custkey, x.bal AS v, row_number() OVER (PARTITION BY r.c_custkey
        ORDER BY sqrt(2.0 * (r.nat - x.nat) * (r.nat - x.nat)), x.c_custkey) AS rn
      FROM c AS r JOIN c AS x ON r.bal IS NULL AND x.bal IS NOT NULL AND r.nat IS NOT NULL AND x.nat IS NOT NULL),
f AS (SELECT c_custkey, avg(v) AS v FROM d WHERE rn <= 3 GROUP BY 1)
SELECT c.c_custkey, coalesce(c.bal, f.v, (SELECT avg(bal) FROM c)) AS bal, coalesce(c.nat, CAST('NaN' AS DOUBLE)) AS nat
FROM c LEFT JOIN f USING (c_custkey)""", ["bal", "nat"], digits=4)
def q_impute_knn_nan(spark, sf):
    """NaN is a missing value, as target and as feature."""
    return impute(_nan_customers(spark, sf), knn=["bal"], k=3, knn_features=["bal", "nat"], knn_order=["c_custkey"])


@register("t_test_constant_groups",
          "SELECT 'inf' AS t_sign, 0.0 AS p_value, 'significant' AS verdict FROM nation WHERE n_nationkey = 0", ["p_value"])
def q_t_test_constant_groups(spark, sf):
    """Two constant groups with different means are infinitely far apart."""
    li = fx.table(spark, sf, "lineitem")
    df = li.select("l_linestatus", F.when(F.col("l_linestatus") == "F", 2.0).otherwise(1.0).alias("v"))
    out = ht.t_test(df, "l_linestatus", "v")
    return out.select(F.when(F.col("t_stat") == float("inf"), "inf").otherwise("finite").alias("t_sign"), "p_value", "verdict")
