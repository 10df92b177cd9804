"""A keys: ingest and export round trips.

The inputs are written by Spark from the driver tables into a fresh folder
under the session's ``spark.checkpoint.dir`` (a shared folder on a cluster),
then read back through the library's readers.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..plans.fit import stage_folder
from ..sources.delimited import read_csv, read_txt
from ..sources.export import export_csv
from ..sources.workbook import parse_workbooks
from ..registry import register
from .sqlgen import rint2

KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
FLOATS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _scratch(spark, what: str) -> str:
    return stage_folder(spark, what)


@register("ingest_csv",
          "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment "
          "FROM customer", ["c_acctbal"])
def q_ingest_csv(spark, sf):
    path = _scratch(spark, "csv") + "/customer.csv"
    fx.table(spark, sf, "customer").write.option("header", True).csv(path)
    return read_csv(spark, path)


@register("ingest_tsv",
          f"SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity, "
          f"l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, "
          f"strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate FROM {fx.LINEITEM_MISSING_SQL} AS m",
          FLOATS)
def q_ingest_tsv(spark, sf):
    path = _scratch(spark, "tsv") + "/lineitem.txt"
    src = fx.lineitem_missing(spark, sf).withColumn("l_shipdate", F.date_format("l_shipdate", "yyyy-MM-dd"))
    src.write.option("header", True).option("sep", "\t").option("nullValue", "NA").csv(path)
    return read_txt(spark, path)


def _export_sql() -> str:
    parts = []
    for c in FLOATS:
        frac = f"(SELECT bool_or({c} <> floor({c})) FROM lineitem)"
        parts.append(f"CASE WHEN {frac} THEN {rint2(c)} ELSE {c} END AS {c}")
    return (f"SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, "
            f"{', '.join(parts)} FROM lineitem")


@register("export_roundtrip", _export_sql(), FLOATS)
def q_export_roundtrip(spark, sf):
    base = _scratch(spark, "export")
    path = export_csv(fx.table(spark, sf, "lineitem").select(*KEYS, *FLOATS), base, "lineitem_clean")
    return read_csv(spark, path)


@register("ingest_csv_rounded",
          "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, "
          f"{rint2('c_acctbal')} AS c_acctbal, c_mktsegment FROM customer", ["c_acctbal"])
def q_ingest_csv_rounded(spark, sf):
    path = _scratch(spark, "csv") + "/customer.csv"
    fx.table(spark, sf, "customer").write.option("header", True).csv(path)
    return read_csv(spark, path, round_decimals=2)


@register("ingest_workbooks",
          "SELECT event_id, date_trunc('second', ts) AS ts, event_type, CASE WHEN event_id % 9 <> 0 THEN value END AS value, "
          "value > 50 AS large FROM events", ["value"])
def q_ingest_workbooks(spark, sf):
    return parse_workbooks(fx.event_workbooks(spark, sf))
