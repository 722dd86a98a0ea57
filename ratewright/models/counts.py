"""Fits of cases with exposure. Rows come as (cases, exposure, weight): equal cases and nearly equal exposure are one row.

The likelihoods depend on a filing through its cases and exposure alone. Filings of a group are therefore added up
by cases and exposure to one part in a thousand before a task fits them, so that a group with any number of
filings reaches its task as a table of bounded size; no filing is left out.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewright.functions.stats import chi2_tail
from ratewright.models.optimise import from_many, golden

MODELS = ("poisson", "nb2", "zip", "zinb")


@dataclass
class Fit:
    model: str
    n: float
    loglik: float
    k: int
    converged: bool
    zero_share: float
    zero_expected: float
    params: dict[str, float] = field(default_factory=dict)
    ring_gain: float = 0.0

    @property
    def aic(self) -> float:
        return 2 * self.k - 2 * self.loglik

    @property
    def bic(self) -> float:
        return self.k * math.log(self.n) - 2 * self.loglik

    @property
    def zero_ratio(self) -> float:
        return self.zero_share / self.zero_expected if self.zero_expected > 0 else math.nan


def log_factorials(y: np.ndarray) -> np.ndarray:
    """log y! of whole numbers, each looked up in a running sum."""
    return np.r_[0.0, np.cumsum(np.log(np.arange(1, int(y.max(initial=0)) + 1)))][y.astype(int)]


def rising(y: np.ndarray, a: float) -> np.ndarray:
    """log of Gamma(y + a) / Gamma(a) for whole y, as a running sum of log(a + i)."""
    return np.r_[0.0, np.cumsum(np.log(a + np.arange(int(y.max(initial=0)))))][y.astype(int)]


def log_pmf(y: np.ndarray, mean: np.ndarray, alpha: float = 0.0) -> np.ndarray:
    """Poisson (alpha 0) or NB2 with variance mean + alpha mean^2."""
    if alpha < 1e-8:
        return y * np.log(np.maximum(mean, 1e-300)) - mean - log_factorials(y)
    a = 1 / alpha
    return rising(y, a) - log_factorials(y) - (y + a) * np.log1p(alpha * mean) + y * np.log(np.maximum(alpha * mean, 1e-300))


def inflated(y: np.ndarray, base: np.ndarray, pi: float) -> np.ndarray:
    """Log probability with an extra share `pi` of zeros."""
    some = np.log1p(-pi) + base
    return np.where(y == 0, np.logaddexp(np.log(max(pi, 1e-300)), some), some)


def prepared(y: np.ndarray, e: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows with usable values; raises if none is left, or if a count isn't whole."""
    ok = np.isfinite(y) & np.isfinite(e) & (y >= 0) & (e > 0) & (w > 0)
    y, e, w = y[ok], e[ok], w[ok]
    if not y.size:
        raise ValueError("no usable rows")
    if (y != np.floor(y)).any():
        raise ValueError("counts must be whole")
    return y, e, w


def expit(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def ring_gain(loss: Callable[[np.ndarray], float], x: np.ndarray, value: float, width: float = 0.05, points: int = 32) -> float:
    """How much less the loss is, at best, on a ring around a fit: points on the axes and in drawn directions, at three distances."""
    ways = np.vstack([np.eye(x.size), -np.eye(x.size), np.random.default_rng(1).normal(size=(points, x.size))])
    ways /= np.linalg.norm(ways, axis=1, keepdims=True)
    return max(value - loss(x + far * way) for far in (width, width / 10, width / 100) for way in ways)


def fit(model: str, y: np.ndarray, e: np.ndarray, w: np.ndarray) -> Fit:
    """Maximum likelihood of one model with mean mu * exposure."""
    y, e, w = prepared(y, e, w)
    if model not in MODELS:
        raise ValueError(f"no such model: {model}")
    n, mu = w.sum(), (w * y).sum() / (w * e).sum()
    zero = w[y == 0].sum() / n
    if mu == 0:
        return Fit(model, float(n), 0.0, 1 + (model != "poisson") + (model == "zinb"), model == "poisson", float(zero), 1.0, {"mu": 0.0})
    if model == "poisson":
        mean = mu * e
        value = float((w * log_pmf(y, mean)).sum())
        gain = ring_gain(lambda x: -float((w * log_pmf(y, math.exp(x[0]) * e)).sum()), np.array([math.log(mu)]), -value)
        return Fit(model, float(n), value, 1, True, float(zero), float((w * np.exp(-mean)).sum() / n), {"mu": float(mu)}, gain)

    def parts(x: np.ndarray) -> tuple[float, float, float]:
        m = math.exp(min(x[0], 300))
        return m, math.exp(min(max(x[1], -20), 12)) if model != "zip" else 0.0, expit(x[-1]) if model != "nb2" else 0.0

    def loss(x: np.ndarray) -> float:
        m, alpha, pi = parts(x)
        base = log_pmf(y, m * e, alpha)
        return -float((w * (inflated(y, base, pi) if model != "nb2" else base)).sum())

    start = math.log(mu)
    extra = {"nb2": [[-1.0], [0.5], [2.0]], "zip": [[-2.0], [0.0], [1.5]], "zinb": [[-1.0, -2.0], [0.5, -1.0], [0.5, 0.5], [1.5, -3.0]]}[model]
    found = from_many(loss, [np.array([start + (0.3 if len(x) > 1 or model == "zip" else 0), *x]) for x in extra])
    m, alpha, pi = parts(found.x)
    at_zero = np.exp(inflated(np.zeros_like(y), log_pmf(np.zeros_like(y), m * e, alpha), pi) if model != "nb2" else log_pmf(np.zeros_like(y), m * e, alpha))
    params = {"mu": m} | ({"alpha": alpha} if model != "zip" else {}) | ({"pi": pi} if model != "nb2" else {})
    on_edge = model != "nb2" and (pi < 1e-6 or pi > 1 - 1e-6)
    return Fit(model, float(n), -found.value, len(found.x), found.converged and not on_edge, float(zero), float((w * at_zero).sum() / n), params, ring_gain(loss, found.x, found.value))


def boundary_test(small: Fit, large: Fit) -> float:
    """P value of a likelihood ratio whose parameter lies on its bound: half the chi-square tail."""
    stat = max(0.0, 2 * (large.loglik - small.loglik))
    return 1.0 if stat == 0 else 0.5 * chi2_tail(stat, max(1, large.k - small.k))


def compare(y: np.ndarray, e: np.ndarray, w: np.ndarray) -> tuple[list[Fit], dict[str, float]]:
    fits = [fit(m, y, e, w) for m in MODELS]
    by = {f.model: f for f in fits}
    return fits, {"nb2_over_poisson": boundary_test(by["poisson"], by["nb2"]), "zip_over_poisson": boundary_test(by["poisson"], by["zip"]), "zinb_over_nb2": boundary_test(by["nb2"], by["zinb"])}


def expected_counts(f: Fit, e: np.ndarray, w: np.ndarray, most: int = 10) -> np.ndarray:
    """Expected filings with 0 .. most - 1 cases, and with `most` or more."""
    out = np.zeros(most + 1)
    for k in range(most):
        y = np.full(e.size, float(k))
        base = log_pmf(y, f.params["mu"] * e, f.params.get("alpha", 0.0))
        out[k] = (w * np.exp(inflated(y, base, f.params["pi"]) if "pi" in f.params else base)).sum()
    out[most] = w.sum() - out[:most].sum()
    return out


def design(band: np.ndarray, w: np.ndarray, fixed: np.ndarray | None = None) -> tuple[np.ndarray, list[str]]:
    """An intercept, a column for each band but the first, and one for each level of `fixed` but the most frequent (of equals
    the first by name); columns without rows, or with all, are left out."""
    columns = [(b, (band == b).astype(float)) for b in sorted({*band})[1:]]
    if fixed is not None:
        levels = sorted({*fixed}, key=lambda v: (-w[fixed == v].sum(), v))
        columns += [(f"fixed {v}", (fixed == v).astype(float)) for v in levels[1:]]
    columns = [(b, c) for b, c in columns if 0 < (w * c).sum() < w.sum()]
    return np.column_stack([np.ones(band.size), *(c for _, c in columns)]), ["intercept", *(b for b, _ in columns)]


def regress(model: str, y: np.ndarray, e: np.ndarray, w: np.ndarray, x: np.ndarray, most: int = 200) -> tuple[np.ndarray, float, float, float, bool]:
    """(coefficients, alpha, pi, log likelihood, converged): log-linear means; the extra zeros have one share, found by EM."""
    beta = np.zeros(x.shape[1])
    beta[0] = math.log(max((w * y).sum(), 1e-9) / (w * e).sum())
    alpha, pi = (0.5 if model in ("nb2", "zinb") else 0.0), (0.1 if model in ("zip", "zinb") else 0.0)
    last = -math.inf

    def loglik(b: np.ndarray, a: float, p: float) -> float:
        base = log_pmf(y, e * np.exp(np.clip(x @ b, -50, 50)), a)
        return float((w * (inflated(y, base, p) if p > 0 else base)).sum())

    for _ in range(most):
        mean = e * np.exp(np.clip(x @ beta, -50, 50))
        if pi > 0:  # the share of each zero that is extra
            own = np.exp(log_pmf(np.zeros_like(y), mean, alpha))
            extra = np.where(y == 0, pi / (pi + (1 - pi) * own), 0.0)
            pi = float(min(max((w * extra).sum() / w.sum(), 0.0), 1 - 1e-9))
        else:
            extra = np.zeros_like(y)
        use = w * (1 - extra)
        for _ in range(25):  # Newton steps on the means, halved where they don't help
            mean = e * np.exp(np.clip(x @ beta, -50, 50))
            grad = x.T @ (use * (y - mean) / (1 + alpha * mean))
            info = (x * (use * mean / (1 + alpha * mean))[:, None]).T @ x + 1e-9 * np.eye(x.shape[1])
            step = np.linalg.solve(info, grad)
            now = float((use * log_pmf(y, mean, alpha)).sum())
            t = 1.0
            while t > 1e-4 and float((use * log_pmf(y, e * np.exp(np.clip(x @ (beta + t * step), -50, 50)), alpha)).sum()) < now:
                t /= 2
            beta = beta + t * step
            if np.abs(t * step).max() < 1e-9:
                break
        if model in ("nb2", "zinb"):
            mean = e * np.exp(np.clip(x @ beta, -50, 50))
            alpha = math.exp(golden(lambda a: -float((use * log_pmf(y, mean, math.exp(a))).sum()), -15, 6))
        value = loglik(beta, alpha, pi)
        if abs(value - last) < 1e-8 * (1 + abs(value)):
            return beta, alpha, pi, value, not (model in ("zip", "zinb") and pi < 1e-6)
        last = value
    return beta, alpha, pi, last, False


SCHEMA = "naics3 string, model string, n double, loglik double, k long, aic double, bic double, converged boolean, zero_share double, zero_expected double, zero_ratio double, params map<string,double>"
FITTED = f"{SCHEMA}, ring_gain double"


def grouped(df: DataFrame, *by: str) -> DataFrame:
    """(by, y, e, w): plausible filings added up by cases and exposure; e is the mean exposure of what was added up.

    Exposure is in 200,000 hours, so that mu is a rate.
    """
    good = df.filter(~F.col("implausible") & (F.col("recordable_cases") >= 0) & (F.col("total_hours_worked") > 0))
    for c in by:
        good = good.filter(F.col(c).isNotNull())
    e = F.col("total_hours_worked") / 200_000.0
    out = good.groupBy(*by, F.col("recordable_cases").alias("y"), F.floor(F.log(e) * 1000).alias("bin")).agg(F.avg(e).alias("e"), F.count("*").cast("double").alias("w"))
    return out.drop("bin")


def select_industries(df: DataFrame, least: int = 200, most: int = 30) -> DataFrame:
    """naics3 of the industries with the most plausible filings, at least `least`; ties by code."""
    n = df.filter(~F.col("implausible") & F.col("naics3").isNotNull()).groupBy("naics3").count().filter(F.col("count") >= least)
    return n.orderBy(F.col("count").desc(), "naics3").limit(most).select("naics3")


def fit_industries(df: DataFrame, models: tuple[str, ...] = MODELS, least: int = 200, most: int = 30) -> DataFrame:
    """One row for each industry and model."""
    rows = grouped(df.join(F.broadcast(select_industries(df, least, most)), "naics3"), "naics3")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        y, e, w = (pdf[c].to_numpy() for c in "yew")
        fits = [fit(m, y, e, w) for m in models]
        return pd.DataFrame([(key[0], f.model, f.n, f.loglik, f.k, f.aic, f.bic, f.converged, f.zero_share, f.zero_expected, f.zero_ratio, f.params, f.ring_gain) for f in fits], columns=[c.split(" ")[0] for c in FITTED.split(", ")])

    return rows.groupBy("naics3").applyInPandas(run, FITTED)


def fit_covariates(df: DataFrame, models: tuple[str, ...] = MODELS, least: int = 200, most: int = 30, fixed: str | None = None) -> DataFrame:
    """The same with a mean for each size band and, if `fixed` names a column, an effect of each of its values."""
    from ratewright.operators.derive import size_band

    banded = df.withColumn("size_band", size_band(F.col("annual_average_employees")))
    by = ["naics3", "size_band", *([fixed] if fixed else [])]
    rows = grouped(banded.join(F.broadcast(select_industries(df, least, most)), "naics3"), *by)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        y, e, w = prepared(*(pdf[c].to_numpy() for c in "yew"))
        x, names = design(pdf["size_band"].to_numpy(), w, pdf[fixed].to_numpy() if fixed else None)
        out = []
        for m in models:
            beta, alpha, pi, value, converged = regress(m, y, e, w, x)
            mean = e * np.exp(x @ beta)
            own = np.exp(log_pmf(np.zeros_like(y), mean, alpha))
            expected = float((w * (pi + (1 - pi) * own)).sum() / w.sum())
            zero = float(w[y == 0].sum() / w.sum())
            k = x.shape[1] + (m in ("nb2", "zinb")) + (m in ("zip", "zinb"))
            params = dict(zip(names, beta.tolist(), strict=True)) | ({"alpha": alpha} if m in ("nb2", "zinb") else {}) | ({"pi": pi} if m in ("zip", "zinb") else {})
            out.append((key[0], m, float(w.sum()), value, k, 2 * k - 2 * value, k * math.log(w.sum()) - 2 * value, converged, zero, expected, zero / expected if expected > 0 else math.nan, params))
        return pd.DataFrame(out, columns=["naics3", "model", "n", "loglik", "k", "aic", "bic", "converged", "zero_share", "zero_expected", "zero_ratio", "params"])

    return rows.groupBy("naics3").applyInPandas(run, SCHEMA)


def predicted_histogram(df: DataFrame, models: tuple[str, ...] = MODELS, least: int = 200, most: int = 30, top: int = 10) -> DataFrame:
    """sort_key, observed and expected filings by number of cases (`top` and more together), under each industry's model of least AIC."""
    rows = grouped(df.join(F.broadcast(select_industries(df, least, most)), "naics3"), "naics3")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        y, e, w = prepared(*(pdf[c].to_numpy() for c in "yew"))
        best = min((fit(m, y, e, w) for m in models), key=lambda f: f.aic)
        seen = np.bincount(np.minimum(y, top).astype(int), weights=w, minlength=top + 1)
        return pd.DataFrame({"sort_key": range(top + 1), "observed": seen, "expected": expected_counts(best, e, w, top)})

    per = rows.groupBy("naics3").applyInPandas(run, "sort_key long, observed double, expected double")
    return per.groupBy("sort_key").agg(F.sum("observed").alias("observed"), F.sum("expected").alias("expected"))


def selection(fits: DataFrame, converged_only: bool = False) -> DataFrame:
    """model, wins: for how many industries a model has the least AIC (ties by name); models without wins count 0."""
    from pyspark.sql import Window

    use = fits.filter("converged") if converged_only else fits
    best = use.withColumn("place", F.row_number().over(Window.partitionBy("naics3").orderBy("aic", "model"))).groupBy("model").agg(F.count_if(F.col("place") == 1).alias("wins"), F.count("*").alias("fits"))
    return best
