"""The normal distribution as SQL text, so that any SQL engine gives the same digits, and as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rational approximation of the inverse normal distribution by P. J. Acklam.
A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
# Error function, Abramowitz and Stegun 7.1.26.
E = (1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592)
LOW = 0.02425


def _poly(x: str, coefficients: tuple[float, ...], last: float | None = None) -> str:
    text = f"CAST({coefficients[0]!r} AS DOUBLE)"
    for c in coefficients[1:] + (() if last is None else (last,)):
        text = f"({text} * {x} + CAST({c!r} AS DOUBLE))"
    return text


def norm_ppf_sql(p: str) -> str:
    """Inverse distribution function of p in (0, 1); null elsewhere."""
    q, r = f"({p} - 0.5)", f"(({p} - 0.5) * ({p} - 0.5))"
    low, high = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))"
    tail = lambda x: f"({_poly(x, C)} / {_poly(x, D, 1.0)})"
    middle = f"({_poly(r, A)} * {q} / {_poly(r, B, 1.0)})"
    return f"(CASE WHEN {p} <= 0 OR {p} >= 1 OR {p} IS NULL THEN NULL WHEN {p} < {LOW} THEN {tail(low)} WHEN {p} > {1 - LOW} THEN -{tail(high)} ELSE {middle} END)"


def norm_cdf_sql(z: str) -> str:
    t = f"(1 / (1 + 0.3275911 * abs({z}) / sqrt(CAST(2 AS DOUBLE))))"
    erf = f"(1 - {_poly(t, E)} * {t} * exp(-{z} * {z} / 2))"
    return f"(CASE WHEN {z} >= 0 THEN 0.5 * (1 + {erf}) ELSE 0.5 * (1 - {erf}) END)"


def norm_ppf(p: str) -> Column:
    return F.expr(norm_ppf_sql(p))


def norm_cdf(z: str) -> Column:
    return F.expr(norm_cdf_sql(z))
