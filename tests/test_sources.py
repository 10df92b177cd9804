import datetime as dt
import os
import tempfile

import pytest

from tablelens.sources.delimited import infer_types, ingest, read_csv, read_txt
from tablelens.sources.export import ExportError, export_csv, export_path
from tablelens.fixtures import workbook_bytes
from tablelens.sources import workbook
from tablelens.sources.workbook import read_workbooks

CSV = ("id,price,flag,when,label,partial,empty,mixed\n"
       "1,1.5,True,2024-01-02,a,7,,x\n"
       "2,NA,False,2024-01-03,n/a,,NA,2\n"
       "3,2.25,True,2024-01-04,c,9,,3\n")


def _write(tmp, name, text):
    p = os.path.join(tmp, name)
    with open(p, "w", encoding="utf-8") as f:
        f.write(text)
    return p


def test_csv_inference(spark):
    tmp = tempfile.mkdtemp(prefix="tl-csv-")
    df = read_csv(spark, _write(tmp, "t.csv", CSV))
    types = dict(df.dtypes)
    assert types == {"id": "bigint", "price": "double", "flag": "boolean", "when": "string", "label": "string",
                     "partial": "double", "empty": "double", "mixed": "string"}
    rows = df.orderBy("id").collect()
    assert rows[1]["price"] is None and rows[1]["label"] is None and rows[0]["when"] == "2024-01-02"


def test_tsv_and_dispatch(spark):
    tmp = tempfile.mkdtemp(prefix="tl-tsv-")
    p = _write(tmp, "t.txt", CSV.replace(",", "\t"))
    assert dict(read_txt(spark, p).dtypes)["price"] == "double"
    assert ingest(spark, p).count() == 3
    with pytest.raises(ValueError):
        ingest(spark, os.path.join(tmp, "t.json"))
    with pytest.raises(ValueError):
        ingest(spark, os.path.join(tmp, "t.xls"))


def _xlsx(path, rows, **kw):
    with open(path, "wb") as f:
        f.write(workbook_bytes(rows, **kw))


def test_workbooks(spark):
    tmp = tempfile.mkdtemp(prefix="tl-xlsx-")
    _xlsx(os.path.join(tmp, "a.xlsx"), [["name", "qty", "ok"], ["x", 1, True], ["y", 2.5, False]])
    _xlsx(os.path.join(tmp, "b.xlsx"), [["name", "qty", "ok"], ["z", 4, True]])
    df = read_workbooks(spark, tmp)
    assert dict(df.dtypes) == {"name": "string", "qty": "double", "ok": "boolean"}
    assert sorted(r["name"] for r in df.collect()) == ["x", "y", "z"]


def test_workbook_dates_and_odd_headers(spark):
    tmp = tempfile.mkdtemp(prefix="tl-xlsx-")
    at = [dt.datetime(2024, 1, 2), dt.datetime(1999, 12, 31, 23, 59, 59), dt.datetime(1900, 3, 1, 6)]
    _xlsx(os.path.join(tmp, "a.xlsx"), [["when", "a.b", None, "x", "x"], [at[0], 1, "q", 1, 2], [None], [at[1], None, None, 3, 4, "beyond"], [at[2], 7]])
    _xlsx(os.path.join(tmp, "b.xlsx"), [["x", "when"], [5, at[1]]], late=True)
    _xlsx(os.path.join(tmp, "c.xlsx"), [["x", "only header"]])
    df = read_workbooks(spark, tmp)
    assert df.columns == ["when", "x", "a.b", "only header", "Unnamed: 2", "x.1", "Unnamed: 5"]
    types = dict(df.dtypes)
    assert types["when"] == "timestamp" and types["x"] == "double" and types["only header"] == "double" and types["a.b"] == "double"
    got = sorted(((r["when"], r["x"], r["a.b"], r["Unnamed: 2"], r["Unnamed: 5"]) for r in df.collect()), key=repr)
    want = [(at[0], 1.0, 1.0, "q", None), (at[1], 3.0, None, None, "beyond"), (at[2], None, 7.0, None, None), (at[1], 5.0, None, None, None)]
    assert got == sorted(want, key=repr)


def test_number_formats():
    kinds = {"yyyy-mm-dd": "date", "dd/mm/yy hh:mm": "date", "mmm-yy": "date", "h:mm AM/PM": "time", "[h]:mm:ss": "", "0.00": "", "General": "",
             '0.0"days"': "", "#,##0.00 [$€-407]": "", "[Red]0.0": "", "[$-409]d-mmm-yyyy;@": "date", "mm:ss": "time", "@": ""}
    assert {k: workbook.format_kind(k) for k in kinds} == kinds
    assert workbook.date_text(45293.5, False) == "2024-01-02 12:00:00" and workbook.date_text(1, False) == "1900-01-01 00:00:00"
    assert workbook.date_text(0.25, True) == "1904-01-01 06:00:00"


def test_a_large_sheet_is_streamed():
    import tracemalloc

    content = workbook_bytes([["id", "text", "price"], *([k, f"t{k % 50}", k / 4] for k in range(100_000))])
    tracemalloc.start()
    n = sum(1 for _ in workbook.sheet_rows(content))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 100_001 and peak < 8 << 20  # a tree of the sheet is over 100 MB


def test_export_rules(spark):
    tmp = tempfile.mkdtemp(prefix="tl-exp-")
    with pytest.raises(ExportError):
        export_path(tmp, "a b")
    with pytest.raises(ExportError):
        export_path(tmp, "ab")
    df = spark.createDataFrame([(1, 1.015), (2, 2.0)], "id long, x double")
    p = export_csv(df, tmp, "clean_01", today=dt.date(2024, 5, 1))
    assert p.endswith("2024-05-01/clean_01.csv")
    back = read_csv(spark, p).orderBy("id").collect()
    assert [r["x"] for r in back] == [1.01, 2.0]
    with pytest.raises(Exception):
        export_csv(df, tmp, "clean_01", today=dt.date(2024, 5, 1))
    with pytest.raises(ExportError):
        export_csv(df.limit(0), tmp, "empty_one")


def test_non_ascii_round_trip(spark):
    tmp = tempfile.mkdtemp(prefix="tl-utf8-")
    df = spark.createDataFrame([(1, "café crème", 1.005), (2, "数据分析", 2.0), (3, "Ωmega ✓", None)],
                               "id long, text string, x double")
    p = export_csv(df, tmp, "utf8-check", today=dt.date(2024, 1, 1))
    back = {r["id"]: (r["text"], r["x"]) for r in read_csv(spark, p).collect()}
    assert back == {1: ("café crème", 1.0), 2: ("数据分析", 2.0), 3: ("Ωmega ✓", None)}
