"""Exact Poisson and binomial statistics as columns: intervals, tails, power, draws.

The functions take batches of rows (pandas UDFs); what a row needs grows with its own counts, never with the table.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ratewright.functions.stats import chi2_tail, clopper_pearson, garwood


def poisson_interval(k: Column, level: float = 0.95) -> Column:
    """struct<low, high>: the exact interval of a Poisson mean from a count; null for a null count."""

    @pandas_udf("low double, high double")
    def run(k: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None) if pd.isna(x) else garwood(int(x), level) for x in k], columns=["low", "high"], dtype="float64")

    return run(k.cast("long"))


def share_interval(k: Column, n: Column, level: float = 0.95) -> Column:
    """struct<low, high>: the exact interval of a share k / n; null without trials."""

    @pandas_udf("low double, high double")
    def run(k: pd.Series, n: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([clopper_pearson(int(a), int(b), level) if b > 0 else (None, None) for a, b in zip(k, n, strict=True)], columns=["low", "high"], dtype="float64")

    return run(k.cast("long"), F.coalesce(n.cast("long"), F.lit(0)))


def chi_square_tail(x: Column, df: Column) -> Column:
    """P(chi-square with df degrees of freedom > x)."""

    @pandas_udf("double")
    def run(x: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([chi2_tail(float(a), int(b)) for a, b in zip(x, df, strict=True)], dtype="float64")

    return run(x.cast("double"), df.cast("int"))


def critical_values(most: int, level: float) -> np.ndarray:
    """For n = 0 .. most: the largest c with 2 P(Binomial(n, 1/2) <= c) <= level; -1 if there is none.

    Both P(.. <= c) and its last term go on from n to n + 1, where c stays or becomes c + 1.
    """
    out = np.full(most + 1, -1, dtype=np.int64)
    c, below, term = -1, 0.0, 0.0
    for n in range(most + 1):
        if c >= 0:
            below -= term / 2
            term *= n / (n - c) / 2
        following = term * (n - c) / (c + 1) if c >= 0 else 0.5**n
        if 2 * (below + following) <= level and 2 * (c + 1) < n:
            c, below, term = c + 1, below + following, following
        out[n] = c
    return out


def reach(critical: np.ndarray) -> np.ndarray:
    """For a larger count b: the greatest lesser count that the test still tells from it; -1 if there is none."""
    n = np.arange(critical.size)
    out = np.full(critical.size, -1, dtype=np.int64)
    some = critical >= 0
    np.maximum.at(out, (n - critical)[some], critical[some])
    return out


def two_rates_power(m1: float, m2: float, table: np.ndarray) -> float:
    """The power of the exact conditional test of two equal rates, where the expected counts are m1 and m2; `table` is reach()."""
    k = np.arange(table.size)
    factorial = np.r_[0.0, np.cumsum(np.log(np.arange(1, table.size)))]
    law = lambda m: np.exp(k * math.log(m) - m - factorial)
    p1, p2 = law(m1), law(m2)
    upto = lambda p: np.where(table >= 0, np.cumsum(p)[np.maximum(table, 0)], 0.0)
    return float(min(1.0, (p2 * upto(p1)).sum() + (p1 * upto(p2)).sum()))


def counts_needed(m: float) -> int:
    """Beyond this no count with a mean of m has a probability worth adding."""
    return int(m + 12 * math.sqrt(m) + 30)


def power(m1: Column, m2: Column, level: float = 0.05) -> Column:
    """Power by expected counts of both periods; 0 where one of them is missing or not above 0."""

    @pandas_udf("double")
    def run(m1: pd.Series, m2: pd.Series) -> pd.Series:
        usable = [a > 0 and b > 0 for a, b in zip(m1, m2, strict=True)]
        largest = max((a + b for a, b, ok in zip(m1, m2, usable, strict=True) if ok), default=0.0)
        critical = critical_values(counts_needed(largest), level)
        out = []
        for a, b, ok in zip(m1, m2, usable, strict=True):
            out.append(two_rates_power(a, b, reach(critical[: counts_needed(a + b) + 1])) if ok else 0.0)
        return pd.Series(out, dtype="float64")

    return run(F.coalesce(m1, F.lit(0.0)).cast("double"), F.coalesce(m2, F.lit(0.0)).cast("double"))


def binomial_draw(n: Column, k: Column, u: Column) -> Column:
    """The binomial count (n trials with probability k / n) that the number u, evenly spread over 0 to 1, stands for: the least
    count up to which the law adds up to u or more."""

    @pandas_udf("long")
    def run(n: pd.Series, k: pd.Series, u: pd.Series) -> pd.Series:
        out = np.zeros(len(n), dtype=np.int64)
        rows = pd.DataFrame({"n": n, "k": k}).groupby(["n", "k"], sort=False).indices
        for (trials, hits), at in rows.items():
            p = hits / trials if trials else 0.0
            if p in (0.0, 1.0):
                out[at] = int(hits)
                continue
            width = 12 * math.sqrt(trials * p * (1 - p)) + 30
            low, high = max(0, int(hits - width)), min(int(trials), int(hits + width))
            j = np.arange(low, high + 1)
            step = np.log((trials - j[1:] + 1) / j[1:]) + math.log(p) - math.log1p(-p)
            first = math.lgamma(trials + 1) - math.lgamma(low + 1) - math.lgamma(trials - low + 1) + low * math.log(p) + (trials - low) * math.log1p(-p)
            law = np.cumsum(np.exp(np.r_[first, first + np.cumsum(step)]))
            out[at] = low + np.minimum(np.searchsorted(law, u.to_numpy()[at], side="left"), high - low)
        return pd.Series(out)

    return run(n.cast("long"), k.cast("long"), u.cast("double"))


def even_number(*parts: Column) -> Column:
    """A number evenly spread over 0 to 1 (52 bits of a digest) that only depends on its parts."""
    digest = F.md5(F.concat_ws("|", *(p.cast("string") for p in parts)))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(16**13)
