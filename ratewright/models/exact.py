"""Maximum likelihood over every filing by itself, all groups in one pass for each step.

fit_industries() adds filings up by nearly equal exposure, which moves likelihoods in the third place. Here its fits are
starts: a pass gives, for each industry and model, the sums over all filings of the log likelihood, its gradient and the products
of each filing's gradient with itself. Those sums are of bounded size; the driver takes the step that they ask for, and steps that lose are
halved, until no fit gains any more.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewright.models.counts import MODELS, fit_industries, inflated, log_pmf

#: Parameters of each model, as they are searched: log mean, log dispersion, logit of the extra zeros.
FREE = {"poisson": ("mu",), "nb2": ("mu", "alpha"), "zip": ("mu", "pi"), "zinb": ("mu", "alpha", "pi")}

#: What a step must gain to be followed by another.
GAIN = 1e-7


def searched(model: str, params: dict[str, float]) -> np.ndarray:
    """Parameters as they are searched, kept off the bounds that they can't reach."""
    forms = {"mu": lambda v: math.log(max(v, 1e-12)), "alpha": lambda v: math.log(min(max(v, 1e-7), 1e5)), "pi": lambda v: math.log(min(max(v, 1e-9), 1 - 1e-9) / (1 - min(max(v, 1e-9), 1 - 1e-9)))}
    return np.array([forms[p](params[p]) for p in FREE[model]])


def parts(model: str, x: np.ndarray) -> tuple[float, float, float]:
    """(mu, alpha, pi); 0 for what a model lacks."""
    at = dict(zip(FREE[model], x, strict=True))
    return math.exp(at["mu"]), math.exp(at["alpha"]) if "alpha" in at else 0.0, 1 / (1 + math.exp(-at["pi"])) if "pi" in at else 0.0


def gradients(model: str, x: np.ndarray, y: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log likelihood of each filing, its derivatives by the searched parameters: one row for each)."""
    mu, alpha, pi = parts(model, x)
    m = mu * e
    base = log_pmf(y, m, alpha)
    rows = {"mu": (y - m) / (1 + alpha * m)}
    if "alpha" in FREE[model]:
        r = 1 / alpha
        harmonic = np.r_[0.0, np.cumsum(1 / (r + np.arange(int(y.max(initial=0)))))][y.astype(int)]
        rows["alpha"] = r * (np.log1p(alpha * m) - harmonic) + (y - m) / (1 + alpha * m)
    if "pi" not in FREE[model]:
        return base, np.vstack([rows[p] for p in FREE[model]])
    value, zero, none = inflated(y, base, pi), y == 0, np.exp(base)
    there = np.where(zero, (1 - pi) * none / np.exp(value), 1.0)  # the chance that a filing is no extra zero
    rows = {p: there * v for p, v in rows.items()}
    rows["pi"] = np.where(zero, pi * (1 - pi) * (1 - none) / np.exp(value), -pi)
    return value, np.vstack([rows[p] for p in FREE[model]])


SUMS = "naics3 string, model string, n long, loglik double, g0 double, g1 double, g2 double, h00 double, h01 double, h02 double, h11 double, h12 double, h22 double"


def one_pass(filings: DataFrame, at: dict[tuple[str, str], np.ndarray]) -> dict[tuple[str, str], tuple[int, float, np.ndarray, np.ndarray]]:
    """For each industry and model: filings, log likelihood, gradient and information at its parameters, in one scan of naics3, y and e."""
    held = filings.sparkSession.sparkContext.broadcast(at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, str], np.ndarray] = {}
        for b in batches:
            group, y, e = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            for industry in np.unique(group.astype(str)):
                own = group == industry
                for model in MODELS:
                    if (x := held.value.get((industry, model))) is not None:
                        value, slopes = gradients(model, x, y[own], e[own])
                        g, h = np.zeros(3), np.zeros((3, 3))
                        g[: x.size], h[: x.size, : x.size] = slopes.sum(axis=1), slopes @ slopes.T
                        total[industry, model] = total.get((industry, model), 0) + np.r_[own.sum(), value.sum(), g, h[np.triu_indices(3)]]
        if total:
            table = np.vstack([*total.values()])
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total]), pa.array([k[1] for k in total]), pa.array(table[:, 0].astype(np.int64)), *(pa.array(c) for c in table[:, 1:].T)], names=[f.split(" ")[0] for f in SUMS.split(", ")])

    names = [f.split(" ")[0] for f in SUMS.split(", ")]
    found = filings.mapInArrow(run, SUMS).groupBy("naics3", "model").agg(*(F.sum(c).alias(c) for c in names[2:])).collect()
    out = {}
    for r in found:
        h = np.zeros((3, 3))
        h[np.triu_indices(3)] = [r[c] for c in names[7:]]
        k = len(FREE[r.model])
        out[r.naics3, r.model] = r.n, r.loglik, np.array([r.g0, r.g1, r.g2])[:k], (h + h.T - np.diag(np.diag(h)))[:k, :k]
    return out


def exact_fits(df: DataFrame, models: tuple[str, ...] = MODELS, least: int = 200, most: int = 30) -> DataFrame:
    """naics3, model, n, k, loglik, loglik_binned, gap (what leaving the binning gains), params, passes: fits over every filing.

    Industries as in fit_industries(): plausible filings with cases and hours, `least` or more, the `most` largest. Fits whose optimum lies on
    a bound (no extra zeros) end near it, when steps gain nothing more. Without such industries there are no rows.
    """
    started = fit_industries(df, models, least, most).select("naics3", "model", "k", "loglik", "params").collect()
    kinds = "naics3 string, model string, n long, k long, loglik double, loglik_binned double, gap double, params map<string,double>, passes long"
    good = df.filter(~F.col("implausible") & (F.col("recordable_cases") >= 0) & (F.col("total_hours_worked") > 0) & F.col("naics3").isin(*{r.naics3 for r in started}))
    filings = good.select("naics3", F.col("recordable_cases").cast("double").alias("y"), (F.col("total_hours_worked") / 200_000.0).alias("e"))
    best = {(r.naics3, r.model): searched(r.model, r.params) for r in started}
    seen = one_pass(filings, best) if best else {}
    # the search ends for each fit by itself; those that go on share the next pass
    steps = {k: np.linalg.lstsq(h + 1e-9 * np.eye(g.size), g, rcond=None)[0] for k, (_, _, g, h) in seen.items()}
    going, passes = {k: 1.0 for k in seen}, 1
    while going:
        tried = {k: best[k] + t * np.clip(steps[k], -2, 2) for k, t in going.items()}
        passes += 1
        after = {}
        for k, found in one_pass(filings, tried).items():
            gain = found[1] - seen[k][1]
            if gain > 0:
                best[k], seen[k] = tried[k], found
                steps[k] = np.linalg.lstsq(found[3] + 1e-9 * np.eye(found[2].size), found[2], rcond=None)[0]
                if gain > GAIN:
                    after[k] = 1.0
            elif going[k] > 1e-3:
                after[k] = going[k] / 4
        going = after
    rows = []
    for r in started:
        n, value, *_ = seen[r.naics3, r.model]
        of = dict(zip(("mu", "alpha", "pi"), parts(r.model, best[r.naics3, r.model]), strict=True))
        rows.append((r.naics3, r.model, n, r.k, float(value), r.loglik, float(value - r.loglik), {p: float(of[p]) for p in FREE[r.model]}, passes))
    return df.sparkSession.createDataFrame(rows, kinds)
