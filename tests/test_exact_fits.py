"""Fits over every filing: gradients by differences, optima that no near point beats."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratewright.models import counts, exact
from ratewright.plans.filings import base


@pytest.mark.parametrize("model", counts.MODELS)
def test_gradients_by_differences(model):
    rng = np.random.default_rng(1)
    y, e = rng.poisson(2, 50) * rng.integers(0, 2, 50).astype(float), rng.uniform(0.1, 3, 50)
    x = np.array([0.3, -0.5, -1.0])[: len(exact.FREE[model])]
    value, slopes = exact.gradients(model, x, y, e)
    for i in range(x.size):
        step = np.zeros(x.size)
        step[i] = 1e-6
        near = (exact.gradients(model, x + step, y, e)[0] - exact.gradients(model, x - step, y, e)[0]) / 2e-6
        assert slopes[i] == pytest.approx(near, abs=1e-6)


def test_every_filing_by_itself(spark):
    df = base(spark, "/root/testdata/sf0.01")
    found = exact.exact_fits(df, ("poisson", "zinb"), most=3).collect()
    assert len(found) == 6 and all(-1e-6 - 0.1 < r.gap < 0.1 for r in found)
    for r in found:
        rows = df.filter(~F.col("implausible") & (F.col("naics3") == r.naics3) & (F.col("total_hours_worked") > 0) & (F.col("recordable_cases") >= 0)).select("recordable_cases", "total_hours_worked").collect()
        y, e = np.array([x[0] for x in rows]), np.array([x[1] for x in rows]) / 200_000
        at = exact.searched(r.model, r.params)
        here = exact.gradients(r.model, at, y, e)[0].sum()
        assert here == pytest.approx(r.loglik, abs=1e-4) and r.n == len(rows)
        for way in np.random.default_rng(2).normal(size=(20, at.size)) * 0.02:
            assert exact.gradients(r.model, at + way, y, e)[0].sum() <= here + 1e-5
    assert exact.exact_fits(df, least=10**9).count() == 0
