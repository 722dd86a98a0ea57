"""Exact statistics over rows: power, ladders, precision, draws, each against direct sums."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratewright.functions import exact, stats
from ratewright.operators import detectability


def binomial(n, k, p):
    return math.comb(n, k) * p**k * (1 - p) ** (n - k)


def critical(n, level=0.05):
    total, c = 0.0, -1
    for k in range(n + 1):
        total += binomial(n, k, 0.5)
        if 2 * total > level:
            return c
        c = k
    return c


def power(m1, m2, level=0.05):
    """Every pair of counts that the test rejects."""
    top = int(m1 + m2 + 10 * math.sqrt(m1 + m2) + 20)
    law = lambda m: [math.exp(k * math.log(m) - m - math.lgamma(k + 1)) for k in range(top + 1)]
    p1, p2 = law(m1), law(m2)
    c = [critical(n, level) for n in range(2 * top + 1)]
    return sum(p1[a] * p2[b] for a in range(top + 1) for b in range(top + 1) if min(a, b) <= c[a + b])


def test_critical_values():
    for level in (0.05, 0.3):
        assert exact.critical_values(120, level).tolist() == [critical(n, level) for n in range(121)]
    assert (np.diff(exact.critical_values(20_000, 0.05)) >= 0).all()


def test_power_against_all_pairs(spark):
    pairs = [(3.0, 6.0), (0.5, 1.0), (12.0, 30.0), (20.0, 20.0), (40.0, 8.0)]
    rows = spark.createDataFrame([*pairs, (None, 1.0), (0.0, 3.0)], "a double, b double")
    found = {(r.a, r.b): r.p for r in rows.select("a", "b", exact.power(F.col("a"), F.col("b")).alias("p")).collect()}
    for a, b in pairs:
        assert found[a, b] == pytest.approx(power(a, b), abs=1e-9)
    assert found[None, 1.0] == found[0.0, 3.0] == 0


def test_first_rung_not_a_bisection(spark):
    """The answer is the first rung that reaches the power; below it none does, though power isn't monotone."""
    rates = spark.createDataFrame([(4.0, 8.0), (4.0, 8.0), (2.0, 7.0), (3.0, 3.0), (0.0, 1.0)], "rate_1 double, rate_2 double")
    found = {r.rate_1: r for r in detectability.hours_for_power(rates).collect()}
    assert set(found) == {4.0, 2.0}
    for one, two in ((4.0, 8.0), (2.0, 7.0)):
        r = found[one]
        tried = [power(one * h / 2e5, two * h / 2e5) for h in (r.hours * 1.01 ** (i - r.rung) for i in range(max(0, r.rung - 6), r.rung + 1))]
        assert tried[-1] >= 0.8 and r.power == pytest.approx(tried[-1], abs=1e-9) and all(x < 0.8 for x in tried[:-1])


def test_least_count_of_a_precision(spark):
    groups = spark.createDataFrame([(2.0,), (1.3,), (1.3,), (8.0,), (1.0,), (None,)], "ratio double")
    found = {r.ratio: r.cases for r in detectability.cases_for_precision(groups).collect()}
    wide = lambda k: stats.garwood(k)[1] / stats.garwood(k)[0]
    for ratio in (2.0, 1.3, 8.0):
        assert wide(found[ratio]) <= ratio and (found[ratio] == 1 or wide(found[ratio] - 1) > ratio)
    assert len(found) == 3 and found[1.3] > detectability.BLOCK


def test_draws_follow_the_law(spark):
    cases = [(40, 3, u / 500) for u in range(1, 500)] + [(7, 7, 0.4), (7, 0, 0.4), (0, 0, 0.9), (100_000, 250, 0.5)]
    df = spark.createDataFrame(cases, "n long, k long, u double")
    for r in df.select("*", exact.binomial_draw(F.col("n"), F.col("k"), F.col("u")).alias("x")).collect():
        if r.n == 40:
            law = np.cumsum([binomial(40, j, 3 / 40) for j in range(41)])
            assert r.x == int(np.searchsorted(law, r.u))
        elif r.n == 100_000:
            assert abs(r.x - 250) <= 1
        else:
            assert r.x == r.k


def test_bootstrap_repeats_and_covers(spark):
    groups = spark.createDataFrame([("a", 100, 1), ("b", 200, 20), ("c", 300, 90), ("none", 0, 0)], "g string, n long, k long")
    run = lambda seed: detectability.gini_bootstrap(groups, "k", "n", "g", 300, seed).first()
    one = run(1)
    points = [(100 / 600, 1 / 111), (300 / 600, 21 / 111), (1.0, 1.0)]
    area = sum((x - a) * (y + b) for (x, y), (a, b) in zip(points, [(0, 0), *points], strict=False))
    assert one.gini == pytest.approx(1 - area) and one.low < one.gini < one.high and one.draws == 300
    assert run(1) == one and run(2) != one


def test_intervals_of_missing_counts(spark):
    df = spark.createDataFrame([(None, 0), (3, 20)], "k long, n long")
    a, b = df.select(exact.poisson_interval(F.col("k")).alias("p"), exact.share_interval(F.col("k"), F.col("n")).alias("s")).collect()
    assert a.p.low is None and a.s.high is None and tuple(b.p) == pytest.approx(stats.garwood(3)) and tuple(b.s) == pytest.approx(stats.clopper_pearson(3, 20))


def test_ladder_of_rates_that_come_out_otherwise_each_time(spark):
    """Sums of doubles depend on the order of rows: bands whose rates differ in their last bits when worked out again lose no row."""
    noise = F.udf(lambda: random.random(), "double").asNondeterministic()
    bands = spark.createDataFrame([("a", 2.5, 50000.0), ("b", 3.1, 90000.0)], "size_band string, rate double, mean_hours double").withColumn("rate", F.col("rate") * (1 + noise() * 1e-13))
    found = detectability.power_by_band(bands, (1.5, 2.0)).collect()
    assert sorted((x.size_band, x.ratio) for x in found) == [("a", 1.5), ("a", 2.0), ("b", 1.5), ("b", 2.0)]
