"""Standard normal quantile and distribution functions as native expressions.

Spark SQL and DuckDB have no ``erf`` and no normal quantile, so both are
written as rational approximations built from ``ln``/``sqrt``/``exp``
arithmetic. Each function exists in two forms generated from the same
coefficient tables:

* ``*_col(Column) -> Column`` runs inside whole-stage codegen (no UDF);
* ``*_sql(str) -> str`` emits SQL text valid in both Spark SQL and DuckDB,
  used by the oracle queries so both engines evaluate the same formula.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Wichura (1988), algorithm AS 241 (PPND16), coefficients listed
# from the highest power of r down to the constant term.
# ---------------------------------------------------------------------------
_AS241_CENTRAL_NUM = [2509.0809287301226727, 33430.575583588128105, 67265.770927008700853,
                      45921.953931549871457, 13731.693765509461125, 1971.5909503065514427,
                      133.14166789178437745, 3.387132872796366608]
_AS241_CENTRAL_DEN = [5226.495278852545925, 28729.085735721942674, 39307.89580009271061,
                      21213.794301586595867, 5394.1960214247511077, 687.1870074920579083,
                      42.313330701600911252, 1.0]
_AS241_MID_NUM = [7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177,
                  1.27045825245236838258, 3.64784832476320460504, 5.7694972214606914055,
                  4.6303378461565452959, 1.42343711074968357734]
_AS241_MID_DEN = [1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966,
                  0.14810397642748007459, 0.68976733498510000455, 1.6763848301838038494,
                  2.05319162663775882187, 1.0]
_AS241_TAIL_NUM = [2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386,
                   0.026532189526576123093, 0.29656057182850489123, 1.7848265399172913358,
                   5.4637849111641143699, 6.6579046435011037772]
_AS241_TAIL_DEN = [2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5,
                   7.868691311456132591e-4, 0.0148753612908506148525, 0.13692988092273580531,
                   0.59983220655588793769, 1.0]

# ---------------------------------------------------------------------------
# Hart (1968) double-precision normal tail as given by
# West (2005), "Better approximations to cumulative normal functions".
# Coefficients from the highest power of |x| down to the constant term.
# ---------------------------------------------------------------------------
_HART_NUM = [0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383,
             112.079291497871, 221.213596169931, 220.206867912376]
_HART_DEN = [0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461,
             296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752]
_HART_SWITCH = 7.07106781186547
_SQRT_2PI = 2.5066282746310002


def _horner_col(r: Column, coefs: list[float]) -> Column:
    acc = F.lit(coefs[0]) * r
    for c in coefs[1:-1]:
        acc = (acc + F.lit(c)) * r
    return acc + F.lit(coefs[-1])


def _horner_sql(r: str, coefs: list[float]) -> str:
    acc = f"({coefs[0]!r} * {r})"
    for c in coefs[1:-1]:
        acc = f"(({acc} + {c!r}) * {r})"
    return f"({acc} + {coefs[-1]!r})"


def ppnd_col(p: Column) -> Column:
    """Φ⁻¹(p) for 0<p<1 (AS 241, ~1e-16 relative); NULL outside (0,1)."""
    p = p.cast("double")
    q = p - F.lit(0.5)
    r_c = F.lit(0.180625) - q * q
    central = q * _horner_col(r_c, _AS241_CENTRAL_NUM) / _horner_col(r_c, _AS241_CENTRAL_DEN)
    r_t = F.sqrt(-F.log(F.least(p, F.lit(1.0) - p)))
    r_m = r_t - F.lit(1.6)
    r_x = r_t - F.lit(5.0)
    mid = _horner_col(r_m, _AS241_MID_NUM) / _horner_col(r_m, _AS241_MID_DEN)
    tail = _horner_col(r_x, _AS241_TAIL_NUM) / _horner_col(r_x, _AS241_TAIL_DEN)
    outer = F.when(r_t <= 5.0, mid).otherwise(tail)
    signed = F.when(q < 0, -outer).otherwise(outer)
    return (F.when((p <= 0) | (p >= 1), F.lit(None).cast("double"))
            .when(F.abs(q) <= 0.425, central)
            .otherwise(signed))


def ppnd_sql(p: str) -> str:
    """SQL text of :func:`ppnd_col`, for Spark SQL and DuckDB alike."""
    p = f"CAST({p} AS DOUBLE)"
    q = f"({p} - 0.5)"
    r_c = f"(0.180625 - {q} * {q})"
    central = f"({q} * {_horner_sql(r_c, _AS241_CENTRAL_NUM)} / {_horner_sql(r_c, _AS241_CENTRAL_DEN)})"
    r_t = f"sqrt(-ln(least({p}, 1.0 - {p})))"
    r_m = f"({r_t} - 1.6)"
    r_x = f"({r_t} - 5.0)"
    mid = f"({_horner_sql(r_m, _AS241_MID_NUM)} / {_horner_sql(r_m, _AS241_MID_DEN)})"
    tail = f"({_horner_sql(r_x, _AS241_TAIL_NUM)} / {_horner_sql(r_x, _AS241_TAIL_DEN)})"
    outer = f"(CASE WHEN {r_t} <= 5.0 THEN {mid} ELSE {tail} END)"
    return (f"(CASE WHEN {p} <= 0 OR {p} >= 1 THEN CAST(NULL AS DOUBLE) "
            f"WHEN abs({q}) <= 0.425 THEN {central} "
            f"WHEN {q} < 0 THEN -{outer} ELSE {outer} END)")


def norm_cdf_col(x: Column) -> Column:
    """Φ(x) with ~1e-15 absolute accuracy (Hart 1968)."""
    x = x.cast("double")
    a = F.abs(x)
    e = F.exp(-a * a / F.lit(2.0))
    near = e * _horner_col(a, _HART_NUM) / _horner_col(a, _HART_DEN)
    cf = a + F.lit(0.65)
    for k in (4.0, 3.0, 2.0, 1.0):
        cf = a + F.lit(k) / cf
    far = e / cf / F.lit(_SQRT_2PI)
    lower = (F.when(a > 37.0, F.lit(0.0))
             .when(a < _HART_SWITCH, near)
             .otherwise(far))
    return F.when(x.isNull(), F.lit(None).cast("double")).when(x > 0, F.lit(1.0) - lower).otherwise(lower)


def norm_cdf_sql(x: str) -> str:
    x = f"CAST({x} AS DOUBLE)"
    a = f"abs({x})"
    e = f"exp(-{a} * {a} / 2.0)"
    near = f"({e} * {_horner_sql(a, _HART_NUM)} / {_horner_sql(a, _HART_DEN)})"
    cf = f"({a} + 0.65)"
    for k in (4.0, 3.0, 2.0, 1.0):
        cf = f"({a} + {k!r} / {cf})"
    far = f"({e} / {cf} / {_SQRT_2PI!r})"
    lower = f"(CASE WHEN {a} > 37.0 THEN 0.0 WHEN {a} < {_HART_SWITCH!r} THEN {near} ELSE {far} END)"
    return f"(CASE WHEN {x} > 0 THEN 1.0 - {lower} ELSE {lower} END)"


def norm_pdf_col(x: Column, mean: Column | float = 0.0, sd: Column | float = 1.0) -> Column:
    mean = mean if isinstance(mean, Column) else F.lit(float(mean))
    sd = sd if isinstance(sd, Column) else F.lit(float(sd))
    z = (x - mean) / sd
    return F.exp(-z * z / F.lit(2.0)) / (sd * F.lit(_SQRT_2PI))


def norm_pdf_sql(x: str, mean: str, sd: str) -> str:
    z = f"(({x} - {mean}) / {sd})"
    return f"(exp(-{z} * {z} / 2.0) / ({sd} * {_SQRT_2PI!r}))"
