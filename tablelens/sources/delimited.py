"""A1, A2, A4, A5 — delimited text ingest with pandas-style type inference.

Files are read as text (``inferSchema`` would type ISO dates as dates, and the
CSV ``nullValue`` option takes one token only). Inference is then **one**
aggregate over every column — counts of present values and of values that
parse as integer, float and boolean — followed by one projection of casts.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.fit import col, one_row, parse_double, parse_long
from .quoted import has_quotes, read_quoted

# The tokens pandas.read_csv treats as missing by default.
PANDAS_NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
                    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
# The spellings pandas parses as booleans.
BOOL_TRUE = ("True", "TRUE", "true")
BOOL_FALSE = ("False", "FALSE", "false")

DELIMITED_EXTENSIONS = {".csv": ",", ".txt": "\t", ".tsv": "\t"}
WORKBOOK_EXTENSIONS = (".xlsx",)


class RaggedRows(ValueError):
    """Some rows have more fields than the header names."""


def _plan_types(df: DataFrame, columns: Sequence[str], na_tokens: Sequence[str], extra: str | None = None,
                bad_header: Column | None = None) -> list:
    """One aggregate over ``df`` -> the typed column expressions for ``columns``.

    ``extra`` names a column that must be empty: the fields beyond the header.
    ``bad_header``: rows that are another file's header and differ; rows with a null there count as data.
    """
    tokens = list(na_tokens)
    cleaned = {c: F.when(~col(c).isin(tokens), col(c)) for c in columns}
    bools = list(BOOL_TRUE + BOOL_FALSE)
    headers = F.count_if(bad_header) if bad_header is not None else F.lit(0)
    if bad_header is not None:  # a file's header is not data
        cleaned = {c: F.when(bad_header.isNull(), x) for c, x in cleaned.items()}
    rows = F.count(F.lit(1)) if bad_header is None else F.count_if(bad_header.isNull())
    beyond = F.count(col(extra)) if extra else F.lit(0)
    aggs = [rows.alias("rows"), beyond.alias("ragged"), headers.alias("headers")]
    for i, c in enumerate(columns):
        x = cleaned[c]
        aggs += [F.count(x).alias(f"p{i}"), F.count(parse_long(x)).alias(f"l{i}"),
                 F.count(parse_double(x)).alias(f"d{i}"), F.count_if(x.isin(bools)).alias(f"b{i}")]
    row = one_row(df.agg(*aggs))
    if row["headers"]:
        raise ValueError(f"the headers of {row['headers']} files are not {list(columns)}")
    if row["ragged"]:
        raise RaggedRows(f"{row['ragged']} rows have more fields than the header's {len(columns)}")
    out = []
    for i, c in enumerate(columns):
        x = cleaned[c]
        present, longs, doubles, bool_n = row[f"p{i}"], row[f"l{i}"], row[f"d{i}"], row[f"b{i}"]
        has_missing = present < row["rows"]
        if present == 0:
            out.append(F.lit(None).cast("double").alias(c))
        elif longs == present and not has_missing:
            out.append(parse_long(x).alias(c))
        elif doubles == present:
            out.append(parse_double(x).alias(c))
        elif bool_n == present and not has_missing:
            out.append(x.isin(list(BOOL_TRUE)).alias(c))
        else:
            out.append(x.alias(c))
    return out


def infer_types(df: DataFrame, na_tokens: Sequence[str] = PANDAS_NA_TOKENS) -> DataFrame:
    """A4: NA tokens → NULL, then per column int64 → float64 → bool → text.

    A number is what pandas parses as one: codes such as ``10D`` stay text. An
    integer column with missing values becomes DOUBLE (as in pandas); a boolean
    column with missing values stays text; an all-missing column is DOUBLE.
    """
    return df.select(*_plan_types(df, df.columns, na_tokens)) if df.columns else df


def _reader(spark: SparkSession, sep: str, encoding: str, multiline: bool):
    return (spark.read.option("header", True).option("sep", sep).option("inferSchema", False)
            .option("quote", '"').option("escape", '"').option("multiLine", multiline)
            .option("encoding", encoding).option("nullValue", None).option("emptyValue", "")
            .option("mode", "PERMISSIVE"))


def read_text_table(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8",
                    multiline: bool = False) -> DataFrame:
    """The raw table by Spark's reader: first row is the header, every column text, nothing inferred.

    With ``multiline`` quoted fields may hold line breaks, and each file is one task.
    Files of one folder must have the same header: another order or other names
    are an error, not a shift of values.
    """
    return _reader(spark, sep, encoding, multiline).option("enforceSchema", False).csv(path)


def _read_typed(spark: SparkSession, path: str, sep: str, encoding: str, multiline: bool) -> DataFrame:
    """Types are planned on a read with one more column, which shows rows longer than the header.

    Every file is read in splits. Where quotes occur, line breaks may be inside
    fields; then the records are found and parsed by :mod:`.quoted` and staged
    once. ``multiline`` reads each file whole instead, in one task.
    """
    extra = "_beyond_header"
    whole = multiline or encoding.upper().startswith("UTF-16")
    in_quotes = not whole and has_quotes(spark, path)
    head = read_text_table(spark, path, sep, encoding, whole or in_quotes)  # a quoted header may hold line breaks
    names = head.columns
    if not names:
        return head
    if not in_quotes:
        reader = _reader(spark, sep, encoding, whole)
        text = [T.StructField(c, T.StringType()) for c in names]
        longer = reader.schema(T.StructType([*text, T.StructField(extra, T.StringType())])).csv(path)
        rows = _reader(spark, sep, encoding, whole).option("enforceSchema", False).schema(T.StructType(text)).csv(path)
        return rows.select(*_plan_types(longer, names, PANDAS_NA_TOKENS, extra))
    names = [*names[:-1], names[-1].removesuffix("\r")]
    rows = read_quoted(spark, path, names, sep, encoding, extra)
    same = F.lit(True)
    for c in names:
        same = same & col(c).eqNullSafe(F.lit(c))
    bad = F.when(col("_header"), ~same)
    typed = _plan_types(rows, names, PANDAS_NA_TOKENS, extra, bad)
    return rows.where(~col("_header")).select(*typed)


def _round_on_load(df: DataFrame, round_decimals: int | None) -> DataFrame:
    """The reference rounds float columns to 2 decimals at load (lossy); opt-in here."""
    if round_decimals is None:
        return df
    from ..operators.columns import round_floats
    return round_floats(df, round_decimals)


def read_csv(spark: SparkSession, path: str, encoding: str = "UTF-8", round_decimals: int | None = None,
             multiline: bool = False) -> DataFrame:
    """A1: comma-separated, header row, pandas-style inferred types. Rows longer than the header are an error.

    Quoted fields may hold the separator, doubled quotes and line breaks, and files are read in splits all the same.
    ``multiline=True`` hands each file whole to one task, for files whose lines end in a lone carriage return.
    """
    return _round_on_load(_read_typed(spark, path, ",", encoding, multiline), round_decimals)


def read_txt(spark: SparkSession, path: str, encoding: str = "UTF-8", round_decimals: int | None = None,
             multiline: bool = False) -> DataFrame:
    """A2: tab-separated text."""
    return _round_on_load(_read_typed(spark, path, "\t", encoding, multiline), round_decimals)


def ingest(spark: SparkSession, path: str, round_decimals: int | None = None, multiline: bool = False) -> DataFrame:
    """A5: dispatch on the extension; anything else is rejected. ``multiline``: see :func:`read_csv`."""
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext in DELIMITED_EXTENSIONS:
        return _round_on_load(_read_typed(spark, path, DELIMITED_EXTENSIONS[ext], "UTF-8", multiline), round_decimals)
    if ext in WORKBOOK_EXTENSIONS:
        from .workbook import read_workbooks
        return _round_on_load(read_workbooks(spark, path), round_decimals)
    if ext == ".xls":
        raise ValueError("legacy binary .xls workbooks are not supported; save as .xlsx")
    raise ValueError(f"unsupported file type {ext!r}: expected .csv, .txt, .tsv or .xlsx")
