"""Fits find the parameters that made the data, and their pieces agree with closed forms."""

import math

import numpy as np
import pytest

from ratewright.models import counts
from ratewright.models.optimise import from_many, golden, simplex


def draw(rng, n, mu, alpha=0.0, pi=0.0):
    e = rng.uniform(0.5, 3, n)
    mean = mu * e
    rate = mean if alpha == 0 else rng.gamma(1 / alpha, alpha * mean)
    y = rng.poisson(rate).astype(float)
    y[rng.random(n) < pi] = 0
    return y, e, np.ones(n)


def test_minimisers():
    f = lambda x: (x[0] - 1) ** 2 + 10 * (x[1] + 2) ** 2
    assert simplex(f, np.zeros(2)).x == pytest.approx([1, -2], abs=1e-3)
    assert from_many(f, [np.zeros(2), np.ones(2)]).converged
    assert golden(lambda x: (x - 3) ** 2, 0, 10) == pytest.approx(3, abs=1e-6)


def test_probabilities():
    y = np.arange(400.0)
    for alpha in (0.0, 0.7):
        assert np.exp(counts.log_pmf(y, np.full(400, 4.0), alpha)).sum() == pytest.approx(1)
    assert counts.log_pmf(np.array([3.0]), np.array([2.0]))[0] == pytest.approx(3 * math.log(2) - 2 - math.log(6))


def test_recovery():
    rng = np.random.default_rng(4)
    y, e, w = draw(rng, 20_000, 3.2, 1.4, 0.18)
    fits, tests = counts.compare(y, e, w)
    by = {f.model: f for f in fits}
    best = min(fits, key=lambda f: f.aic)
    assert best.model == "zinb" and best.params["mu"] == pytest.approx(3.2, rel=0.1) and best.params["alpha"] == pytest.approx(1.4, abs=0.3) and best.params["pi"] == pytest.approx(0.18, abs=0.06)
    assert by["poisson"].loglik < by["zip"].loglik < best.loglik and tests["nb2_over_poisson"] < 1e-6
    assert counts.expected_counts(best, e, w)[0] == pytest.approx((y == 0).sum(), rel=0.05)


def test_poisson_data_needs_no_more():
    y, e, w = draw(np.random.default_rng(5), 5000, 2.0)
    f = counts.fit("poisson", y, e, w)
    assert f.params["mu"] == pytest.approx(y.sum() / e.sum())
    assert counts.fit("nb2", y, e, w).params["alpha"] < 0.02
    assert not counts.fit("zinb", y, e, w).converged or counts.fit("zinb", y, e, w).params["pi"] < 0.05


def test_weights_are_repeats():
    y, e, _ = draw(np.random.default_rng(6), 300, 2.0, 0.8)
    a = counts.fit("nb2", np.repeat(y, 3), np.repeat(e, 3), np.ones(900))
    b = counts.fit("nb2", y, e, np.full(300, 3.0))
    assert a.loglik == pytest.approx(b.loglik) and a.n == b.n


def test_regression_recovers_bands():
    rng = np.random.default_rng(7)
    n = 20_000
    band = rng.choice(["a", "b"], n)
    e = rng.uniform(0.5, 2, n)
    mean = e * np.where(band == "a", 1.0, 3.0)
    y = rng.poisson(rng.gamma(2.0, mean / 2)).astype(float)
    x, names = counts.design(band, np.ones(n))
    beta, alpha, pi, value, ok = counts.regress("nb2", y, e, np.ones(n), x)
    assert names == ["intercept", "b"] and beta == pytest.approx([0, math.log(3)], abs=0.08) and alpha == pytest.approx(0.5, abs=0.08) and ok
    y[rng.random(n) < 0.3] = 0
    beta, alpha, pi, _, ok = counts.regress("zinb", y, e, np.ones(n), x)
    assert pi == pytest.approx(0.3, abs=0.06) and ok


def test_bad_rows():
    with pytest.raises(ValueError):
        counts.prepared(np.array([1.5]), np.array([1.0]), np.array([1.0]))
    with pytest.raises(ValueError):
        counts.prepared(np.array([-1.0]), np.array([1.0]), np.array([1.0]))
    with pytest.raises(ValueError):
        counts.fit("other", np.array([1.0]), np.array([1.0]), np.array([1.0]))
    assert counts.fit("poisson", np.zeros(3), np.ones(3), np.ones(3)).loglik == 0
