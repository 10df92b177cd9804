"""Registered queries: one Spark builder and (when expressible) one DuckDB twin.

``Spec.floats`` names the DOUBLE output columns; both sides round them to
``digits`` decimals so summation order cannot flip the value hash.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .plans.fit import col


@dataclass
class Spec:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    floats: list[str] = field(default_factory=list)
    digits: int = 6

    def oracle(self) -> str:
        if not self.floats:
            return self.sql.strip()
        # "+ 0.0" folds a rounded -0.0 into 0.0 (DuckDB keeps the sign, Spark does not).
        repl = ", ".join(f"round({c}, {self.digits}) + CAST(0 AS DOUBLE) AS {c}" for c in self.floats)
        return f"SELECT * REPLACE ({repl}) FROM (\n{self.sql.strip()}\n) AS _q"


REGISTRY: dict[str, Spec] = {}


def register(name: str, sql: str | None, floats: list[str] | None = None, digits: int = 6):
    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        REGISTRY[name] = Spec(name, fn, sql, list(floats or []), digits)
        return fn
    return deco


def finish(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every DOUBLE column to ``digits`` decimals (mirrors ``Spec.oracle``)."""
    return df.select(*[(F.round(col(f.name), digits) + F.lit(0.0)).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else col(f.name)
                       for f in df.schema.fields])


# Sections register themselves on import.
from . import catalog  # noqa: E402,F401
