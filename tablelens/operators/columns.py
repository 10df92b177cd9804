"""B — projections, predicates and row selection (all lazy, no driver data)."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.fit import FLOAT_TYPES, NUMERIC_TYPES, col, collect_bounded, materialize, missing_cond, parse_double

ROLE_QUANTITATIVE = "quantitative"
ROLE_QUALITATIVE = "qualitative"
ROLE_TEMPORAL = "temporal"
ROLE_OTHER = "other"



def role_of(dt: T.DataType, field: T.StructField | None = None) -> str:
    if isinstance(dt, NUMERIC_TYPES):
        return ROLE_QUANTITATIVE
    if isinstance(dt, (T.StringType, T.BooleanType)):
        return ROLE_QUALITATIVE
    if isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return ROLE_TEMPORAL
    return ROLE_OTHER


def type_name(dt: T.DataType) -> str:
    return dt.simpleString()


def search_columns(df: DataFrame, pattern: str) -> DataFrame:
    """B1: keep the columns whose name matches ``pattern`` (regex, case-insensitive).

    No match gives a frame with no columns (reported, not raised).
    """
    rx = re.compile(pattern, re.IGNORECASE)
    return df.select(*[col(c) for c in df.columns if rx.search(c)])


def _present_counts(df: DataFrame) -> dict[str, int]:
    aggs = [F.count(F.when(~missing_cond(df, c), 1)).alias(str(i)) for i, c in enumerate(df.columns)]
    row = collect_bounded(df.agg(*aggs), 1)[0] if aggs else []
    return dict(zip(df.columns, row))


def column_roles(df: DataFrame, counts: bool = False) -> DataFrame:
    """B2: (variable, dtype, role) — a schema walk. ``counts`` adds ``present``, the number
    of values that are not missing, from one aggregate over the data."""
    rows = [(f.name, type_name(f.dataType), role_of(f.dataType)) for f in df.schema.fields]
    schema = "variable string, dtype string, role string"
    if counts:
        present = _present_counts(df)
        rows, schema = [(*r, present[r[0]]) for r in rows], schema + ", present long"
    return df.sparkSession.createDataFrame(rows, schema)


def schema_report(df: DataFrame, counts: bool = False) -> DataFrame:
    """(position, variable, dtype), and ``present`` as in :func:`column_roles`."""
    rows = [(i + 1, f.name, type_name(f.dataType)) for i, f in enumerate(df.schema.fields)]
    schema = "position int, variable string, dtype string"
    if counts:
        present = _present_counts(df)
        rows, schema = [(*r, present[r[1]]) for r in rows], schema + ", present long"
    return df.sparkSession.createDataFrame(rows, schema)


def round_half_even(c: Column, digits: int = 2) -> Column:
    """numpy-style rounding: rint(x·10^d)/10^d (1.015 → 1.01, 2.675 → 2.68)."""
    scale = float(10 ** digits)
    return F.rint(c * F.lit(scale)) / F.lit(scale)


def round_floats(df: DataFrame, digits: int = 2, only_fractional: bool = True) -> DataFrame:
    """Round float columns; a column whose values are all whole is left as is.

    The "any fractional value?" test for every float column is one aggregate
    (a handful of booleans reach the driver).
    """
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, FLOAT_TYPES)]
    if not floats:
        return df
    targets = floats
    if only_fractional:
        flags = collect_bounded(df.agg(*[
            F.max(F.when(~F.isnan(col(c)) & (col(c) != F.floor(col(c))), F.lit(1)).otherwise(F.lit(0)))
            .alias(c) for c in floats]), 1)[0]
        targets = [c for c in floats if flags[c] == 1]
    return df.select(*[round_half_even(col(c), digits).alias(c) if c in targets else col(c)
                       for c in df.columns])


def drop_missing(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with NULL (or NaN) in any of ``subset`` (default: all columns)."""
    for name in subset or df.columns:
        df = drop_missing_of(df, name)
    return df


def drop_missing_of(df: DataFrame, name: str) -> DataFrame:
    """Rows where ``name`` is present."""
    c = col(name)
    cond = c.isNotNull()
    if isinstance(df.schema[name].dataType, FLOAT_TYPES):
        cond = cond & ~F.isnan(c)
    return df.where(cond)


def select_rows(df: DataFrame, key: str | Sequence[str], selection: DataFrame | Sequence) -> DataFrame:
    """Keep rows whose key appears in ``selection`` (a DataFrame of keys or a list).

    Either becomes a semi-join; adaptive execution broadcasts the selection when
    its measured size allows.
    """
    keys = [key] if isinstance(key, str) else list(key)
    if not isinstance(selection, DataFrame):
        schema = df.select(*[col(k) for k in keys]).schema
        selection = df.sparkSession.createDataFrame([tuple(v) if len(keys) > 1 else (v,) for v in selection], schema)
    return df.join(selection.select(*[col(k) for k in keys]).distinct(), on=keys, how="left_semi")


def preview(df: DataFrame, n: int = 5, order_by: Sequence[str] | str | None = None) -> DataFrame:
    """First ``n`` rows in ``order_by`` order (TakeOrderedAndProject: per-task top-n)."""
    if order_by:
        cols = [order_by] if isinstance(order_by, str) else list(order_by)
        return df.orderBy(*map(col, cols)).limit(n)
    return df.limit(n)


def to_numeric(c: str | Column) -> Column:
    """``pd.to_numeric(errors='coerce')`` — what pandas does not parse as a number → NULL."""
    return parse_double(col(c) if isinstance(c, str) else c)


def group_label(c: str | Column, null_label: str = "None") -> Column:
    """Group key as text; a missing key becomes its own labelled group."""
    return F.coalesce((col(c) if isinstance(c, str) else c).cast("string"), F.lit(null_label))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN → NULL in every floating column."""
    return df.select(*[F.when(~F.isnan(col(f.name)), col(f.name)).alias(f.name)
                       if isinstance(f.dataType, FLOAT_TYPES) else col(f.name)
                       for f in df.schema.fields])


def value_share(df: DataFrame, name: str, value) -> DataFrame:
    """Rows equal to ``value`` and their share of *all* rows (nulls included)."""
    hit = col(name) == F.lit(value)
    return df.agg(F.count_if(hit).alias("matches"),
                  F.count(F.lit(1)).alias("rows"),
                  (F.count_if(hit) * F.lit(100.0) / F.count(F.lit(1))).alias("pct"))


def is_empty(df: DataFrame) -> bool:
    """Non-empty gate (a LIMIT 1 job)."""
    return df.isEmpty()


def _total_order(df: DataFrame, order_by: Sequence[str] | str | None) -> list[Column]:
    """Ascending by ``order_by`` (NULL first, compared as their own type), then by every other
    sortable column, so that only identical rows are tied."""
    first = [order_by] if isinstance(order_by, str) else list(order_by or [])
    rest = [f.name for f in df.schema.fields if f.name not in first and "map<" not in f.dataType.simpleString()]
    return [col(c).asc_nulls_first() for c in [*first, *rest]]


def with_positions(df: DataFrame, order_by: Sequence[str] | str, name: str = "_pos") -> DataFrame:
    """Adds the 0-based row position in ``order_by`` order, unique for every row.

    Rows are range-partitioned, sorted within partitions and written once; a
    position is the row's place in its partition plus the sizes of the
    partitions before it (one collected number per partition). Keys of any type,
    NULL keys (first) and ties (broken by the other columns) all get a position.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    order = _total_order(df, order_by)
    placed = materialize(df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
                         .select(F.struct("*").alias("_row"), F.monotonically_increasing_id().alias("_id")))
    part = F.shiftright("_id", 33)
    sizes = collect_bounded(placed.groupBy(part.cast("int").alias("p")).count(), parts)
    before, starts = 0, []
    for p, n in sorted((r["p"], r["count"]) for r in sizes):
        starts.append((p, before))
        before += n
    starts = df.sparkSession.createDataFrame(starts, "_p int, _before long")
    return (placed.withColumn("_p", part.cast("int")).join(F.broadcast(starts), "_p")
            .select("_row.*", (F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1)).alias(name)))


class PositionIndex:
    """B7/B8 for tables that are paged through again and again: rows with their positions, stored once in that order.

    Files and their row groups hold runs of positions, so a page or a selection,
    however deep, is a pushed-down range filter that reads the row groups with
    those positions and nothing else. ``rows_per_group`` bounds what a page reads.
    The files lie in the stage folder and go with the session.
    """

    def __init__(self, df: DataFrame, order_by: Sequence[str] | str, rows_per_group: int = 100_000):
        self.columns = df.columns
        placed = with_positions(df, order_by).select(*map(col, df.columns), "_pos")
        # Rows come in order from the stage of with_positions; a bound on a page's rows bounds the groups.
        self.rows = materialize(placed.sortWithinPartitions("_pos"), options={"parquet.block.row.count.limit": rows_per_group})

    def _at(self, low: int, high: int) -> DataFrame:
        return self.rows.where((F.col("_pos") >= low) & (F.col("_pos") <= high))

    def page(self, page_no: int, size: int = 10) -> DataFrame:
        """Rows [page_no·size, (page_no+1)·size) in order."""
        if page_no < 0 or size < 1:
            raise ValueError("page_no must be >= 0 and size >= 1")
        return self._at(page_no * size, (page_no + 1) * size - 1).orderBy("_pos").select(*map(col, self.columns))

    def select(self, positions: Sequence[int]) -> DataFrame:
        """Rows at the given positions (those that exist)."""
        wanted = sorted({int(p) for p in positions})
        if not wanted:
            return self.rows.where(F.lit(False)).select(*map(col, self.columns))
        rows = self._at(wanted[0], wanted[-1])
        if len(wanted) <= 1000:  # as a filter, which also skips row groups in between
            return rows.where(F.col("_pos").isin(wanted)).select(*map(col, self.columns))
        keys = self.rows.sparkSession.createDataFrame([(p,) for p in wanted], "_pos long")
        return rows.join(keys, "_pos", "left_semi").select(*map(col, self.columns))


def select_positions(df: DataFrame, order_by: Sequence[str] | str, positions: Sequence[int]) -> DataFrame:
    """B7 by position (``iloc``): rows at the given 0-based positions in ``order_by`` order."""
    wanted = df.sparkSession.createDataFrame([(int(p),) for p in sorted(set(positions))], "_pos long")
    return with_positions(df, order_by).join(wanted, "_pos", "left_semi").drop("_pos")


def page(df: DataFrame, page_no: int, size: int = 10, order_by: Sequence[str] | str | None = None) -> DataFrame:
    """B8 pages: rows [page_no·size, (page_no+1)·size) in ``order_by`` order (NULL first, ties by the other columns).

    One plan for every size, type and key: ORDER BY … LIMIT … OFFSET, where each
    task hands on at most the rows up to the page's end. For deep pages, or a
    table that is paged through again and again, keep a :class:`PositionIndex`.
    """
    if page_no < 0 or size < 1:
        raise ValueError("page_no must be >= 0 and size >= 1")
    ordered = df.orderBy(*_total_order(df, order_by)) if order_by else df
    return ordered.offset(page_no * size).limit(size)


def sample_rows(df: DataFrame, max_rows: int, seed: int = 42, row_key: Sequence[str] | None = None) -> DataFrame:
    """At most ``max_rows`` rows, exactly that many if there are more.

    With ``row_key`` (columns that tell rows apart) the rows with the smallest
    md5 of seed and key are taken: the same on every run and engine. Without,
    every row draws a seeded random number, equal rows too, which depends on how
    the table is partitioned.

    Two steps keep the merge small: the rows are counted, and only those are
    sorted whose draw is below a threshold that ``max_rows`` and a few spare ones
    are expected to pass, so all tasks together hand on about ``max_rows`` rows. In
    the rare case that fewer pass, the threshold is doubled.
    """
    if row_key:
        rows, order = df, _total_order(df, row_key)
        draw = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(col(k).cast("string"), F.lit("")) for k in row_key]).cast("binary"))
        passes = lambda share: F.substring(draw, 1, 8) <= F.lit(f"{int(share * 0xFFFFFFFF):08x}")
    else:
        rows, order = df.withColumn("_draw", F.rand(seed)), []
        draw = F.col("_draw")
        passes = lambda share: draw <= F.lit(share)
    total = rows.count()
    share = min(1.0, (max_rows + 6 * math.sqrt(max_rows) + 16) / max(total, 1))
    while share < 1.0 and rows.where(passes(share)).count() < max_rows:
        share = min(1.0, 2 * share)
    few = rows.where(passes(share)) if share < 1.0 else rows
    return few.orderBy(draw, *order).limit(max_rows).select(*map(col, df.columns))
