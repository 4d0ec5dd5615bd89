"""Distribution functions that have no SQL form, in numpy, for pandas UDFs over one row per group."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Log gamma of each number; made anew in each call, as a vectorised function that tasks hold can't be pickled."""
    return np.vectorize(math.lgamma, otypes=[float])(x)


def beta_inc(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by Lentz's continued fraction."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.clip(np.asarray(x, float), 0, 1))
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    tiny = 1e-300
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
        c, d = np.ones_like(y), 1 / np.where(np.abs(1 - (p + q) * y / (p + 1)) < tiny, tiny, 1 - (p + q) * y / (p + 1))
        f = d.copy()
        for m in range(1, 400):
            for term in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1 + term * d
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1 + term / np.where(np.abs(c) < tiny, tiny, c)
                f = f * d * c
            if np.all(np.abs(d * c - 1) < 1e-14):
                break
        out = np.where(y == 0, 0.0, front * f)
    return np.where(swap, 1 - out, out)


def t_cdf(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    t, df = np.asarray(t, float), np.asarray(df, float)
    half = 0.5 * beta_inc(df / 2, 0.5, df / (df + t * t))
    return np.where(t > 0, 1 - half, half)


def f_cdf(f: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    f, d1, d2 = (np.asarray(v, float) for v in (f, d1, d2))
    return beta_inc(d1 / 2, d2 / 2, d1 * f / (d1 * f + d2))


def t_p_value(t: str, df: str) -> Column:
    """Two-sided p of a t statistic."""

    @F.pandas_udf("double")
    def p(t: pd.Series, df: pd.Series) -> pd.Series:
        ok = t.notna() & df.notna() & (df > 0)
        out = pd.Series(np.nan, index=t.index)
        out[ok] = 2 * t_cdf(-t[ok].abs().to_numpy(float), df[ok].to_numpy(float))
        return out

    return F.nanvl(p(F.col(t), F.col(df).cast("double")), F.lit(None))


def f_p_value(f: str, d1: str, d2: str) -> Column:
    @F.pandas_udf("double")
    def p(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
        return pd.Series(1 - f_cdf(f.fillna(0).to_numpy(float), d1.to_numpy(float), d2.to_numpy(float)))

    return p(F.col(f), F.col(d1).cast("double"), F.col(d2).cast("double"))


_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(200)
_U, _W = (_NODES + 1) / 2, _WEIGHTS / 2


def jzs_bayes_factor(t: np.ndarray, n: np.ndarray, df: np.ndarray, r: float = math.sqrt(0.5)) -> np.ndarray:
    """BF10 of a t statistic with a Cauchy prior of scale r: integral over g with g = u / (1 - u)."""
    t, n, df = (np.asarray(v, float)[:, None] for v in (t, n, df))
    g = _U / (1 - _U)
    prior = r / math.sqrt(2 * math.pi) * g**-1.5 * np.exp(-r * r / (2 * g)) / (1 - _U) ** 2
    scale = 1 + n * g
    log_ratio = -0.5 * np.log(scale) - (df + 1) / 2 * (np.log1p(t * t / (scale * df)) - np.log1p(t * t / df))
    return (np.exp(log_ratio) * prior * _W).sum(axis=1)


def bayes_factor_t(t: str, n: str, df: str, r: float = math.sqrt(0.5)) -> Column:
    @F.pandas_udf("double")
    def bf(t: pd.Series, n: pd.Series, df: pd.Series) -> pd.Series:
        ok = t.notna() & n.notna() & (df > 0)
        out = pd.Series(np.nan, index=t.index)
        if ok.any():
            out[ok] = jzs_bayes_factor(t[ok].to_numpy(float), n[ok].to_numpy(float), df[ok].to_numpy(float), r)
        return out

    return F.nanvl(bf(F.col(t), F.col(n).cast("double"), F.col(df).cast("double")), F.lit(None))


def likelihood_ratio(t: np.ndarray, df: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Density of a noncentral t over that of a central one at t, for noncentralities in the columns of shift.

    The ratio is exp(-m^2 df / (2 (df + t^2))) I(a) / I(0) with a = m t / sqrt(df + t^2) and I(a) the integral of
    u^df exp(-(u - a)^2 / 2) over u > 0, taken around its peak.
    """
    t, df = np.asarray(t, float)[:, None], np.asarray(df, float)[:, None]
    a = shift * t / np.sqrt(df + t * t)
    peak = (a + np.sqrt(a * a + 4 * df)) / 2
    lo = np.maximum(peak - 9, 0.0)
    u = lo[..., None] + (peak + 9 - lo)[..., None] * _U
    log_top = df * np.log(peak) - (peak - a) ** 2 / 2
    with np.errstate(divide="ignore"):
        inner = np.exp(df[..., None] * np.log(u) - (u - a[..., None]) ** 2 / 2 - log_top[..., None])
    log_a = log_top + np.log((inner * _W).sum(axis=-1) * (peak + 9 - lo))
    return np.exp(log_a - ((df - 1) / 2 * math.log(2) + _lgamma((df + 1) / 2)) - shift * shift * df / (2 * (df + t * t)))


def interval_ratio(t: np.ndarray, n: np.ndarray, df: np.ndarray, lo: float = -math.inf, hi: float = math.inf, r: float = math.sqrt(0.5)) -> np.ndarray:
    """Mean likelihood ratio of a t statistic against no effect, over effects between lo and hi of a Cauchy prior of scale r.

    (0, inf) is the one-sided Bayes factor, the whole line the two-sided one. n is the effective number: that of one sample,
    or n1 n2 / (n1 + n2) of two.
    """
    t, n, df = (np.asarray(v, float) for v in (t, n, df))
    a, b = (math.atan(x / r) / math.pi for x in (lo, hi))
    # the law of the effect has a narrow peak at t / sqrt(n): it is met by more nodes around there
    out = np.zeros(len(t))
    for k in range(len(t)):
        middle = math.atan(t[k] / math.sqrt(n[k]) / r) / math.pi
        wide = 6 / math.sqrt(n[k]) / r / math.pi
        cuts = sorted({a, b, *(min(max(middle + step * wide, a), b) for step in (-1, 0, 1))})
        for x, y in zip(cuts, cuts[1:]):
            effect = r * np.tan(math.pi * (x + (y - x) * _U))
            out[k] += (likelihood_ratio(t[k : k + 1], df[k : k + 1], effect[None] * math.sqrt(n[k]))[0] * _W).sum() * (y - x)
    return out / (b - a)


def bayes_factor_between(t: str, n: str, df: str, lo: float, hi: float, r: float = math.sqrt(0.5)) -> Column:
    """BF of effects between lo and hi against no effect; null for a null t or n, or df below 1."""

    @F.pandas_udf("double")
    def bf(t: pd.Series, n: pd.Series, df: pd.Series) -> pd.Series:
        ok = t.notna() & n.notna() & (df > 0)
        out = pd.Series(np.nan, index=t.index)
        if ok.any():
            out[ok] = interval_ratio(t[ok].to_numpy(float), n[ok].to_numpy(float), df[ok].to_numpy(float), lo, hi, r)
        return out

    return F.nanvl(bf(F.col(t), F.col(n).cast("double"), F.col(df).cast("double")), F.lit(None))


def interval_null_bf01(t: str, n: str, df: str, width: float, r: float = math.sqrt(0.5)) -> Column:
    """BF01 of an interval null: effects between -width and width against all others of the prior."""
    share = 2 * math.atan(width / r) / math.pi
    inside, whole = bayes_factor_between(t, n, df, -width, width, r), bayes_factor_between(t, n, df, -math.inf, math.inf, r)
    return inside * (1 - share) / (whole - share * inside)


def log_beta(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _lgamma(a) + _lgamma(b) - _lgamma(a + b)


def empirical_null_bf(k: str, n: str, hits: str, draws: str, prior: tuple[float, float] = (1.0, 1.0), null_prior: tuple[float, float] = (1000.0, 1000.0), cap: float = 5000.0) -> Column:
    """BF10 of k successes in n, a beta prior against the beta posterior of null accuracies.

    hits is the sum of null accuracies times n, of which the whole part counts, draws their number. The null's parameters
    keep their ratio and are at most `cap`. Null where one of the columns is null.
    """

    @F.pandas_udf("double")
    def bf(k: pd.Series, n: pd.Series, hits: pd.Series, draws: pd.Series) -> pd.Series:
        k, n, hits, draws = (v.to_numpy(float) for v in (k, n, hits, draws))
        hits = np.trunc(hits)
        a, b = null_prior[0] + hits, null_prior[1] + draws * n - hits
        scale = np.minimum(1.0, cap / np.maximum(a, b))
        a, b = a * scale, b * scale
        fine = ~np.isnan(k + n + a + b)
        out = np.full(len(k), np.nan)
        k, n, a, b = (v[fine] for v in (k, n, a, b))
        one = log_beta(prior[0] + k, prior[1] + n - k) - log_beta(np.full(len(k), prior[0]), np.full(len(k), prior[1]))
        out[fine] = np.exp(one - (log_beta(a + k, b + n - k) - log_beta(a, b)))
        return pd.Series(out)

    return F.nanvl(bf(*[F.col(c).cast("double") for c in (k, n, hits, draws)]), F.lit(None))


def chi2_sf(x: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(chi-square of df degrees of freedom > x), df whole numbers above 0."""

    def one(x: float, df: int) -> float:
        half = max(x, 0.0) / 2
        if df % 2 == 0:
            term = total = math.exp(-half)
            for i in range(1, df // 2):
                term *= half / i
                total += term
            return total
        total, term = math.erfc(math.sqrt(half)), math.sqrt(half) * math.exp(-half) / math.gamma(1.5)
        for i in range(1, (df + 1) // 2):
            total += term
            term *= half / (i + 0.5)
        return total

    return np.vectorize(one, otypes=[float])(x, df)


def chi2_p_value(x: str, df: str) -> Column:
    @F.pandas_udf("double")
    def p(x: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series(chi2_sf(x.to_numpy(float), df.to_numpy(int)))

    return p(F.col(x), F.col(df))


def beta_binomial_bf(k: str, n: str, chance: float = 0.5) -> Column:
    """BF10 of k successes in n against a fixed chance, with a flat prior."""

    @F.pandas_udf("double")
    def bf(k: pd.Series, n: pd.Series) -> pd.Series:
        a, b = k.to_numpy(float), n.to_numpy(float)
        return pd.Series(np.exp(_lgamma(a + 1) + _lgamma(b - a + 1) - _lgamma(b + 2) - a * math.log(chance) - (b - a) * math.log(1 - chance)))

    return bf(F.col(k), F.col(n))


def binomial_p(k: str, n: str, chance: float = 0.5) -> Column:
    """P(K >= k) under chance."""

    @F.pandas_udf("double")
    def p(k: pd.Series, n: pd.Series) -> pd.Series:
        a, b = k.to_numpy(float), n.to_numpy(float)
        return pd.Series(np.where(a <= 0, 1.0, beta_inc(np.maximum(a, 1e-9), b - a + 1, chance)))

    return p(F.col(k), F.col(n))


def kendall_bayes_factor(tau: str, n: str) -> Column:
    """BF10 of Kendall's tau: the normal law of the standardised tau against its shifted law under a stretched beta(1) prior."""

    @F.pandas_udf("double")
    def bf(tau: pd.Series, n: pd.Series) -> pd.Series:
        x, m = tau.fillna(0).to_numpy(float)[:, None], n.to_numpy(float)[:, None]
        unit = x * np.sqrt(9 * m * (m - 1) / (4 * m + 10)) / np.sqrt(m)
        delta = 3 / 2 * _NODES
        prior = math.pi / 2 * np.cos(math.pi * _NODES / 2) / 2
        log = -0.5 * m * ((unit - delta) ** 2 - unit**2)
        return pd.Series((np.exp(log) * prior * _WEIGHTS).sum(axis=1))

    return bf(F.col(tau), F.col(n))
