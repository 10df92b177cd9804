"""Small plan helpers shared by the operators.

``collect_bounded`` is the only way operators move data to the driver: it is
used for fitted parameters (one row, O(#columns) values) and split points, and
it refuses anything beyond the stated bound instead of silently pulling data.
"""

from __future__ import annotations

import functools
import inspect
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                 T.FloatType, T.DoubleType, T.DecimalType)
FLOAT_TYPES = (T.FloatType, T.DoubleType)
INTEGRAL_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


#: Rows of per-key parameters (a few numbers each) that are broadcast.
BROADCAST_KEYS = 100_000

# Fixed value: the spellings of a number that pandas parses (no Java suffixes such as 10D).
NUMBER_PATTERN = r"(?i)^\s*[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf|infinity|nan)\s*$"
INTEGER_PATTERN = r"^\s*[+-]?\d+\s*$"


def col(name: str) -> Column:
    """A column by its exact name, whatever characters (dots, spaces, back quotes) the name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def plain_names(*columns: str, out: Sequence[str] = ()):
    """Decorator for operators ``f(df, …)``: they see plain column names, whatever the names are.

    ``columns`` are the parameters that name a column (or a list of them); the
    table and they are renamed on the way in. Those in ``out`` get their own
    names back in the result. So dots, spaces, back quotes and names that an
    operator uses itself need no care inside.
    """
    def wrap(f):
        signature = inspect.signature(f)

        @functools.wraps(f)
        def run(*args, **kwargs):
            bound = signature.bind(*args, **kwargs)
            bound.apply_defaults()
            table, *_ = bound.arguments
            df = bound.arguments[table]
            plain = {c: f"_col{i}" for i, c in reversed(list(enumerate(df.columns)))}

            def new(name: str) -> str:
                if name in plain:
                    return plain[name]
                same = [c for c in plain if c.lower() == name.lower()]  # Spark's names have no case
                if len(same) != 1:
                    raise ValueError(f"no column {name!r} in {df.columns}")
                return plain[same[0]]
            named = {p: bound.arguments[p] for p in columns if bound.arguments[p] is not None}
            for p, v in named.items():
                bound.arguments[p] = new(v) if isinstance(v, str) else [new(c) for c in v]
            bound.arguments[table] = df.toDF(*[f"_col{i}" for i in range(len(df.columns))])
            result = f(*bound.args, **bound.kwargs)
            for p in out:
                if p in named:
                    result = result.withColumnRenamed(bound.arguments[p], named[p])
            return result
        return run
    return wrap


def parse_double(c: Column, dt: T.DataType | None = None) -> Column:
    """Text to DOUBLE as pandas reads numbers, NULL where it is none; other types are cast."""
    if dt is not None and not isinstance(dt, T.StringType):
        return c.try_cast("double")
    return F.when(c.cast("string").rlike(NUMBER_PATTERN), F.trim(c.cast("string")).try_cast("double"))


def parse_long(c: Column, dt: T.DataType | None = None) -> Column:
    """Text to BIGINT, NULL where it is no whole number; other types are cast."""
    if dt is not None and not isinstance(dt, T.StringType):
        return c.try_cast("bigint")
    return F.when(c.cast("string").rlike(INTEGER_PATTERN), F.trim(c.cast("string")).try_cast("bigint"))


class BoundExceeded(RuntimeError):
    """A driver-side collect would exceed its declared bound."""


def collect_bounded(df: DataFrame, max_rows: int) -> list[Row]:
    """Collect at most ``max_rows`` rows; raise if the frame is larger."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise BoundExceeded(f"expected at most {max_rows} rows on the driver")
    return rows


def one_row(df: DataFrame) -> Row:
    rows = collect_bounded(df, 1)
    if not rows:
        raise BoundExceeded("expected exactly one aggregate row")
    return rows[0]


def dtype_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, NUMERIC_TYPES)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def qualitative_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, (T.StringType, T.BooleanType))]


def as_double(c: str | Column) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return col.cast("double")


def missing_cond(df: DataFrame, name: str) -> Column:
    """NULL, and NaN for floating columns (pandas treats NaN as missing)."""
    c = col(name)
    if isinstance(dtype_of(df, name), FLOAT_TYPES):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def clean_value(df: DataFrame, name: str) -> Column:
    """Column value with NaN mapped to NULL."""
    c = col(name)
    if isinstance(dtype_of(df, name), FLOAT_TYPES):
        return F.when(~F.isnan(c), c)
    return c


def safe_div(num: Column, den: Column) -> Column:
    """num/den, NULL when den is 0 or NULL (ANSI division would raise)."""
    return F.when(den != 0, num / den)


def long_form(df: DataFrame, cols: Sequence[str], value_type: str = "double",
              keys: Iterable[str] = ()) -> DataFrame:
    """(keys…, variable, value) with one row per (row, column); NaN → NULL.

    Built with ``unpivot`` (an Expand), so one scan feeds every column and the
    following aggregate shuffles once for all columns.
    """
    keys = list(keys)

    def as_value(c: str) -> Column:
        if value_type == "string" and isinstance(dtype_of(df, c), T.BooleanType):
            # pandas spells booleans True / False
            return F.when(col(c), F.lit("True")).when(~col(c), F.lit("False"))
        return clean_value(df, c).cast(value_type)

    prepared = df.select(*[col(k) for k in keys], *[as_value(c).alias(c) for c in cols])
    return prepared.unpivot([col(k) for k in keys], [col(c) for c in cols], "variable", "value")


def typed_lit(value, dt: T.DataType) -> Column:
    """A literal of type ``dt`` (structs and arrays built field by field)."""
    if value is None:
        return F.lit(None).cast(dt)
    if isinstance(dt, T.StructType):
        return F.struct(*[typed_lit(value[f.name], f.dataType).alias(f.name) for f in dt.fields])
    if isinstance(dt, T.ArrayType):
        return F.array(*[typed_lit(v, dt.elementType) for v in value]).cast(dt)
    return F.lit(value).cast(dt)


def attach(df: DataFrame, params: DataFrame, keys: Sequence[str], grouped: bool,
           how: str = "inner", broadcast: bool | None = None) -> DataFrame:
    """Add per-key parameters to ``df``.

    Grouped: an equi-join on the keys. Unless the caller knows the size, the
    parameters are computed once and counted: up to ``BROADCAST_KEYS`` rows are
    broadcast, so ``df`` is not shuffled by a key that may be hot; more are
    joined, and adaptive execution splits skewed keys. Ungrouped: ``params`` holds at most one row, which is
    collected (a bounded fit) and added as literals — no join at all.
    """
    if grouped:
        if broadcast is None:
            params = materialize(params)
            broadcast = params.count() <= BROADCAST_KEYS
        return df.join(F.broadcast(params) if broadcast else params, list(keys), how)
    rows = collect_bounded(params, 1)
    fields = [f for f in params.schema.fields if f.name not in keys]
    if not rows:
        if how == "inner":
            return df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in fields]).where(F.lit(False))
        return df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in fields])
    return df.select("*", *[typed_lit(rows[0][f.name], f.dataType).alias(f.name) for f in fields])


def stage_folder(spark, name: str) -> str:
    """A new path under the session's ``spark.checkpoint.dir``, deleted when the driver's JVM ends."""
    import uuid

    from ..session import ensure_checkpoint_dir
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tablelens-{name}-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def materialize(df: DataFrame, max_rows: int | None = None, options: dict | None = None) -> DataFrame:
    """Compute ``df`` once and cut its lineage.

    With ``max_rows`` the frame is known to be small: it is collected (bounded)
    and recreated on the driver. Otherwise it is written once as parquet under
    the session's ``spark.checkpoint.dir`` (a shared folder on a cluster) and
    read back, which survives executor loss and is computed exactly once.
    """
    if max_rows is not None:
        rows = collect_bounded(df, max_rows)
        return df.sparkSession.createDataFrame(rows, df.schema)
    path = stage_folder(df.sparkSession, "stage")
    df.write.mode("errorifexists").options(**options or {}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
