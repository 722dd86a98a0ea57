"""Percentiles by selection of ranks, against sorting."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratewright.operators import ranks

SHARES = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 1.0]


def wanted(groups):
    return {k: (len(v), [pytest.approx(float(np.quantile(v, p)), rel=1e-12, abs=1e-300) for p in SHARES]) for k, v in groups.items()}


@pytest.mark.parametrize(("ranges", "ranked"), [(4096, 200_000), (40, 6)])
def test_against_sorting(spark, ranges, ranked):
    r = random.Random(ranges)
    groups = {
        "all": [r.lognormvariate(0, 3) for _ in range(900)] + [0.0] * 900, "ties": [float(r.randrange(3)) for _ in range(500)], "one": [5.0], "two": [1.0, 2.0], "same": [7.0] * 300,
        "steep": [10.0 ** r.uniform(-300, 300) for _ in range(200)], "wide": [-1.7e308, 1.7e308, 0.0, 1.0, -1.0], "small": [5e-324, 0.0, 1e-323, -5e-324],
    }
    rows = [(k, x) for k, v in groups.items() for x in v] + [("none", None), ("nan", float("nan")), ("inf", float("inf")), (None, 1.0)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, x double")
    found = ranks.percentiles(df, ["k"], "x", SHARES, ranges, ranked).collect()
    assert {x.k: (x.n_values, x.cuts) for x in found} == wanted(groups)
    assert ranks.percentiles(df.filter("false"), ["k"], "x", SHARES, ranges, ranked).count() == 0


def test_one_group_of_all_rows(spark):
    df = spark.range(300_000).select((F.xxhash64("id") / 1e10).alias("x"), F.lit("same").alias("k"))
    every = np.sort(np.array([x.x for x in df.collect()]))
    for keys in ([], ["k"]):
        found = ranks.percentiles(df, keys, "x", [0.5, 0.95], 512, 5_000)
        assert found.columns == [*keys, "n_values", "cuts"]
        assert found.first().cuts == [pytest.approx(float(np.quantile(every, p)), rel=1e-13) for p in (0.5, 0.95)]


def test_no_group_is_gathered(spark):
    df = spark.createDataFrame([("a", 1.0)], "k string, x double")
    plan = ranks.percentiles(df, ["k"], "x", [0.5])._jdf.queryExecution().toString().lower()
    assert "percentile(" not in plan
