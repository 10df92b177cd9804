"""A7, A8 — CSV export with the reference's name rules and 2-decimal floats.

The output is a directory of part files written by the executors (no
driver-side file). ``mode("errorifexists")`` gives the "already exists"
failure atomically.
"""

from __future__ import annotations

import datetime as _dt
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.columns import round_floats
from ..plans.fit import FLOAT_TYPES, col

# Fixed value: allowed export names (3 to 40 word characters or dashes).
NAME_PATTERN = r"^[\w-]{3,40}$"


class ExportError(ValueError):
    pass


def export_path(base_dir: str, name: str, today: _dt.date | None = None) -> str:
    if not name or not re.match(NAME_PATTERN, name):
        raise ExportError("invalid file name: use 3-40 letters, digits, '_' or '-'")
    clean = re.sub(r"[^\w-]", "", name)
    day = (today or _dt.date.today()).strftime("%Y-%m-%d")
    return f"{base_dir.rstrip('/')}/{day}/{clean}.csv"


def export_csv(df: DataFrame, base_dir: str, name: str, digits: int = 2, single_file: bool = False,
               today: _dt.date | None = None) -> str:
    """Round floats (B3), format them with ``%.{digits}f``, write a header CSV.

    A8: an empty frame is refused. ``single_file=True`` coalesces to one part
    (only for small results). Returns the written directory.
    """
    path = export_path(base_dir, name, today)
    if df.isEmpty():
        raise ExportError("nothing to export: the table is empty")
    rounded = round_floats(df, digits)
    fmt = f"%.{digits}f"
    # NULL and NaN are written as empty fields, as pandas does (Java's %.2f would
    # print a truncated "null").
    out = rounded.select(*[F.when(col(f.name).isNotNull() & ~F.isnan(col(f.name)),
                                  F.format_string(fmt, col(f.name))).alias(f.name)
                           if isinstance(f.dataType, FLOAT_TYPES) else col(f.name)
                           for f in rounded.schema.fields])
    if single_file:
        out = out.coalesce(1)
    # Quotes are doubled, text keeps its blanks and line breaks, an empty text is "" and a NULL nothing.
    (out.write.mode("errorifexists").option("header", True).option("quote", '"').option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("emptyValue", '""').csv(path))
    return path
