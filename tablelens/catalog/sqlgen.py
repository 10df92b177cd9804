"""SQL text builders for the DuckDB twins (kept next to the catalogue)."""

from __future__ import annotations


def union_all(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def missing_sql(col: str, is_float: bool) -> str:
    if is_float:
        return f"count(*) FILTER (WHERE {col} IS NULL OR isnan({col}))"
    return f"count(*) FILTER (WHERE {col} IS NULL)"


def clean_sql(col: str, is_float: bool) -> str:
    """NaN → NULL, as DOUBLE."""
    if is_float:
        return f"CASE WHEN NOT isnan({col}) THEN CAST({col} AS DOUBLE) END"
    return f"CAST({col} AS DOUBLE)"


def rint2(expr: str, digits: int = 2) -> str:
    scale = 10 ** digits
    return f"(round_even(({expr}) * {scale}.0, 0) / {scale}.0)"


def D(expr: str) -> str:
    """CAST to DOUBLE (DuckDB decimal literals would otherwise turn arithmetic DECIMAL)."""
    return f"CAST({expr} AS DOUBLE)"
