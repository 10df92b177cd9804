"""E — type conversion with a per-column report.

All failure counts come from **one** aggregate over the source; the
conversion itself is then **one** projection. A column that would lose data
(unparsable values) is left unchanged and reported as failed — atomically per
column.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.fit import FLOAT_TYPES, one_row, parse_double, parse_long
from ..plans.fit import col as named

TARGETS = {"int64": "bigint", "float64": "double", "category": "string", "object": "string",
           "text": "string", "datetime": "timestamp"}

# Tried in order. Of the two slash formats a column is read by one only: month first,
# as pandas does, unless day first parses more of its values.
DEFAULT_DATETIME_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd",
                            "MM/dd/yyyy", "dd/MM/yyyy", "yyyy/MM/dd")

_AMBIGUOUS = ("MM/dd/yyyy", "dd/MM/yyyy")


def _present(df: DataFrame, c: str) -> Column:
    col = named(c)
    if isinstance(df.schema[c].dataType, FLOAT_TYPES):
        return col.isNotNull() & ~F.isnan(col)
    return col.isNotNull()


def _parsed(df: DataFrame, c: str, target: str, formats: Sequence[str]) -> Column:
    col = named(c)
    dt = df.schema[c].dataType
    if target == "int64":
        return F.when(_present(df, c), parse_long(col, dt))
    if target == "float64":
        return F.when(_present(df, c), parse_double(col, dt))
    if target in ("category", "object", "text"):
        return col.cast("string")
    if target == "datetime":
        if isinstance(dt, (T.TimestampType, T.DateType, T.TimestampNTZType)):
            return col.cast("timestamp")
        s = col.cast("string")
        # ISO text in all its forms (fractions, Z, offsets) first, then the other formats.
        return F.coalesce(s.try_cast("timestamp"), *[F.try_to_timestamp(s, F.lit(f)) for f in formats])
    raise ValueError(f"unknown target type {target!r}; expected one of {sorted(TARGETS)}")


def _fail_count(df: DataFrame, c: str, target: str, formats: Sequence[str]) -> Column:
    if target in ("int64", "float64"):
        return F.count_if(_present(df, c) & _parsed(df, c, target, formats).isNull())
    return F.lit(0).cast("long")


def plan_conversion(df: DataFrame, targets: Mapping[str, str],
                    formats: Sequence[str] = DEFAULT_DATETIME_FORMATS) -> list[dict]:
    """One aggregate → per column {variable, from, to, status, failed_rows, nulls_filled}."""
    checks = []
    for c, target in targets.items():
        if c not in df.columns:
            raise ValueError(f"unknown column {c!r}")
        if target not in TARGETS:
            raise ValueError(f"unknown target type {target!r}")
        checks += [_fail_count(df, c, target, formats).alias(f"{c}__fail"),
                   F.count_if(~_present(df, c)).alias(f"{c}__missing")]
        if target == "datetime":
            text = named(c).cast("string")
            checks += [F.count(F.try_to_timestamp(text, F.lit(f))).alias(f"{c}__{i}") for i, f in enumerate(_AMBIGUOUS)]
    row = one_row(df.agg(*checks)) if checks else None
    plan = []
    for c, target in targets.items():
        current = df.schema[c].dataType.simpleString()
        wanted = TARGETS[target]
        failed = int(row[f"{c}__fail"])
        missing = int(row[f"{c}__missing"])
        unchanged = current == wanted and target not in ("category",)
        if unchanged:
            status = "skipped (type unchanged)"
        elif failed:
            status = "failed"
        else:
            status = "converted"
        kept = list(formats)
        if target == "datetime":
            month_first, day_first = row[f"{c}__0"], row[f"{c}__1"]
            drop = _AMBIGUOUS[1] if month_first >= day_first else _AMBIGUOUS[0]
            kept = [f for f in formats if f != drop or not set(_AMBIGUOUS) <= set(formats)]
        plan.append({"formats": kept, "variable": c, "from_type": current, "to_type": target, "status": status,
                     "failed_rows": failed,
                     "nulls_filled": missing if (target == "int64" and status == "converted") else 0})
    return plan


def apply_conversion(df: DataFrame, plan: list[dict],
                     formats: Sequence[str] = DEFAULT_DATETIME_FORMATS) -> DataFrame:
    """E1-E5 as one projection. int64 fills missing with 0 (NaN → 0 then cast)."""
    todo = {p["variable"]: p["to_type"] for p in plan if p["status"] == "converted"}
    own_formats = {p["variable"]: p.get("formats", formats) for p in plan}
    out = []
    for c in df.columns:
        if c not in todo:
            out.append(named(c))
            continue
        target = todo[c]
        expr = _parsed(df, c, target, own_formats[c])
        if target == "int64":
            expr = F.coalesce(expr, F.lit(0).cast("bigint"))
        meta = {"role": "category"} if target == "category" else None
        out.append(expr.alias(c, metadata=meta) if meta else expr.alias(c))
    return df.select(*out)


def convert(df: DataFrame, targets: Mapping[str, str],
            formats: Sequence[str] = DEFAULT_DATETIME_FORMATS) -> tuple[DataFrame, DataFrame]:
    """Convert columns; returns (converted frame, report frame)."""
    plan = plan_conversion(df, targets, formats)
    report = df.sparkSession.createDataFrame(
        [(p["variable"], p["from_type"], p["to_type"], p["status"], p["failed_rows"], p["nulls_filled"])
         for p in plan],
        "variable string, from_type string, to_type string, status string, failed_rows long, nulls_filled long")
    return apply_conversion(df, plan, formats), report


def convert_preview(df: DataFrame, targets: Mapping[str, str], n: int = 5,
                    order_by: Sequence[str] | None = None) -> DataFrame:
    """First ``n`` rows of the converted frame."""
    out, _ = convert(df, targets)
    return out.orderBy(*map(named, order_by)).limit(n) if order_by else out.limit(n)
