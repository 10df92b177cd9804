"""Derived test inputs (FIXTURES.md), each defined once for Spark and once as SQL.

The driver tables contain no NULLs, so missing values are introduced with a
deterministic rule over whole tables — no rows are dropped or sampled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def lineitem_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 7 != 0, F.col("l_quantity")).alias("l_quantity"),
        "l_extendedprice",
        F.when(F.col("l_partkey") % 11 != 0, F.col("l_discount")).alias("l_discount"),
        "l_tax",
        F.when(F.col("l_suppkey") % 13 != 0, F.col("l_returnflag")).alias("l_returnflag"),
        "l_linestatus", "l_shipdate")


LINEITEM_MISSING_SQL = """(SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
  CASE WHEN (l_orderkey + l_linenumber) % 7 <> 0 THEN l_quantity END AS l_quantity,
  l_extendedprice,
  CASE WHEN l_partkey % 11 <> 0 THEN l_discount END AS l_discount,
  l_tax,
  CASE WHEN l_suppkey % 13 <> 0 THEN l_returnflag END AS l_returnflag,
  l_linestatus, l_shipdate FROM lineitem)"""


def customer_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", "c_name", "c_nationkey",
                    F.when(F.col("c_custkey") % 10 != 0, F.col("c_acctbal")).alias("c_acctbal"),
                    "c_mktsegment")


CUSTOMER_MISSING_SQL = """(SELECT c_custkey, c_name, c_nationkey,
  CASE WHEN c_custkey % 10 <> 0 THEN c_acctbal END AS c_acctbal, c_mktsegment FROM customer)"""


def lineitem_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.withColumn("l_tax", F.when(F.col("l_linenumber") == 3, F.lit(float("nan")))
                         .otherwise(F.col("l_tax")))


LINEITEM_NAN_SQL = """(SELECT * REPLACE (CASE WHEN l_linenumber = 3 THEN CAST('NaN' AS DOUBLE)
  ELSE l_tax END AS l_tax) FROM lineitem)"""


def part_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    size_text = (F.when(F.col("p_partkey") % 40 == 0, F.lit(None).cast("string"))
                 .when(F.col("p_partkey") % 50 == 0, F.lit("abc"))
                 .otherwise(F.col("p_size").cast("string")))
    price_text = F.when(F.col("p_partkey") % 40 == 0, F.lit(None).cast("string")) \
        .otherwise(F.col("p_retailprice").cast("string"))
    return p.select("p_partkey", "p_name", "p_brand", "p_type",
                    size_text.alias("p_size"), price_text.alias("p_retailprice"),
                    F.col("p_size").cast("string").alias("p_size_text"))


PART_TEXT_SQL = """(SELECT p_partkey, p_name, p_brand, p_type,
  CASE WHEN p_partkey % 40 = 0 THEN NULL WHEN p_partkey % 50 = 0 THEN 'abc'
       ELSE CAST(p_size AS VARCHAR) END AS p_size,
  CASE WHEN p_partkey % 40 = 0 THEN NULL ELSE CAST(p_retailprice AS VARCHAR) END AS p_retailprice,
  CAST(p_size AS VARCHAR) AS p_size_text FROM part)"""


def order_dates_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    txt = F.when(F.col("o_orderkey") % 20 == 0, F.lit("not a date")) \
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return o.select("o_orderkey", "o_orderstatus", txt.alias("o_orderdate"))


ORDER_DATES_TEXT_SQL = """(SELECT o_orderkey, o_orderstatus,
  CASE WHEN o_orderkey % 20 = 0 THEN 'not a date' ELSE strftime(o_orderdate, '%Y-%m-%d') END
  AS o_orderdate FROM orders)"""


_XML = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def workbook_bytes(rows, dates=(), late: bool = False) -> bytes:
    """A minimal ``.xlsx`` of one sheet: the first row is the header, None is no cell, ``dates`` the columns shown as dates."""
    import io
    import zipfile
    from datetime import datetime
    from xml.sax.saxutils import escape

    start, shared, lines = datetime(1904, 1, 1) if late else datetime(1899, 12, 30), {}, []
    for r, row in enumerate(rows, start=1):
        cells = []
        for c, v in enumerate(row):
            ref = f"{chr(65 + c)}{r}"
            if isinstance(v, str):
                cells.append(f'<c r="{ref}" t="s"><v>{shared.setdefault(v, len(shared))}</v></c>')
            elif isinstance(v, bool):
                cells.append(f'<c r="{ref}" t="b"><v>{int(v)}</v></c>')
            elif isinstance(v, datetime):
                span = v - start
                cells.append(f'<c r="{ref}" s="1"><v>{span.days + (span.seconds * 10**6 + span.microseconds) / 864e8!r}</v></c>')
            elif v is not None:
                cells.append(f'<c r="{ref}"{" s=\"1\"" if c in dates and r > 1 else ""}><v>{v!r}</v></c>')
        lines.append(f'<row r="{r}">{"".join(cells)}</row>')
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook {_XML} xmlns:r="{_REL}"><workbookPr date1904="{int(late)}"/><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                   f'<Relationship Id="rId1" Target="worksheets/sheet1.xml" Type="{_REL}/worksheet"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet {_XML}><numFmts count="1"><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd hh:mm:ss"/></numFmts>'
                   '<cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="164"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {_XML}><sheetData>{"".join(lines)}</sheetData></worksheet>')
        z.writestr("xl/sharedStrings.xml", f'<sst {_XML}>' + "".join(f'<si><t xml:space="preserve">{escape(s)}</t></si>' for s in shared) + "</sst>")
    return out.getvalue()


def event_workbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): all events as workbooks of 2,000 ids each; every other one has its columns in another order."""
    columns = ["event_id", "ts", "event_type", "value", "large"]

    def book(key, group):
        order = columns[::-1] if key[0] % 2 else columns
        rows = [[None if v is None or v != v else v.to_pydatetime() if c == "ts" else v for c, v in zip(order, row)]
                for row in group[order].astype(object).itertuples(index=False, name=None)]
        import pandas as pd
        return pd.DataFrame({"path": [f"{key[0]}.xlsx"], "content": [workbook_bytes([order, *rows])]})
    events = table(spark, sf_dir, "events").select(
        "event_id", F.date_trunc("second", "ts").alias("ts"), "event_type", F.when(F.col("event_id") % 9 != 0, F.col("value")).alias("value"),
        (F.col("value") > 50).alias("large"), F.floor(F.col("event_id") / 2000).alias("book"))
    return events.groupBy("book").applyInPandas(book, "path string, content binary")
