"""Two-year reviews: influence by direct removal, exclusions, restoring; audits that must refuse broken tables."""

import pytest
from pyspark.sql import functions as F

from ratewright.operators import audit, review
from ratewright.operators.peers import percentile_table
from ratewright.plans.filings import base
from ratewright.sources.loader import UploadError


def rows(spark):
    data = [(2023, 10.0, 20000.0 + i, float(i % 3), f"a{i}") for i in range(30)] + [(2024, 10.0, 21000.0 + i, float(i % 4), f"a{i}") for i in range(30)] + [(2024, 1000.0, 4_000_000.0, 0.0, "big"), (2024, 1.0, 9000.0, 1.0, "odd"), (2022, 1.0, 2000.0, 1.0, "old")]
    return spark.createDataFrame(data, "year int, employees double, hours double, cases double, filing_id string")


def test_influence_is_direct_removal(spark):
    out = {r.key: r for r in review.analyse(rows(spark)).collect()}
    assert len(out) == 62 and not out["2024:odd"].passes and out["2024:odd"].rate_without is None
    good = [r for r in out.values() if r.passes and r.year == 2024]
    for r in good[:5] + [out["2024:big"]]:
        rest = [x for x in good if x.key != r.key]
        assert r.rate_without == pytest.approx(200_000 * sum(x.cases for x in rest) / sum(x.hours for x in rest))
    assert out["2024:big"].rank == 1 and out["2024:big"].reverses


def test_exclusions_and_restoring(spark):
    df = rows(spark)
    text = review.save_review("a" * 64, (2023, 2024), 120, 4500, ("2024:big",), "one site")
    found, note = review.restore_review(df, "a" * 64, text)
    by = {r.year: r for r in review.annual(found).collect()}
    assert note == "one site" and by[2024].excluded == 1 and by[2024].rejected == 1 and by[2024].review_rate > by[2024].rate and by[2023].review_rate == by[2023].rate
    for bad, code in (("{}", "bad_review"), (text.replace('"a', '"b'), "other_source"), (review.save_review("a" * 64, (2023, 2024), 120, 4500, ("2024:odd",)), "bad_review"), (review.save_review("a" * 64, (2023, 2024), 120, 4500, ("2024:none",)), "unknown_key"), (review.save_review("a" * 64, (2001, 2024), 120, 4500, ()), "bad_years")):
        with pytest.raises(UploadError) as e:
            review.restore_review(df, "a" * 64, bad)
        assert e.value.code == code
    with pytest.raises(UploadError):
        review.analyse(df.unionByName(df.limit(1)))


def test_scaling_keeps_the_ratio(spark):
    row = spark.range(1).select(*(v.alias(k) for k, v in review.scaled(F.lit(2000.0), F.lit(1.0), F.lit(3.0), F.lit(50.0), F.lit(1e6), 10).items())).first()
    assert row.hours_per_employee == 2000 and row.row_rate == pytest.approx(30) and row.pool_rate == pytest.approx(200_000 * 50 / (1e6 + 9 * 2000))


def test_cells_must_add_up(spark):
    df = base(spark, "/root/testdata/sf0.001")
    table = percentile_table(df, least=2)
    assert all(r.agrees for r in audit.reconciled(audit.validate_cells(table), df).collect())
    with pytest.raises(ValueError):
        audit.validate_cells(table.unionByName(table.limit(1)))
    with pytest.raises(ValueError):
        audit.validate_cells(table.withColumn("aggregate_trir", F.col("aggregate_trir") * 1.01 + 0.3))


def test_hashes_and_samples(spark):
    df = spark.createDataFrame([(2, 0.5), (1, 1.25)], "y int, v double")
    import hashlib

    assert audit.series_hash(df, "y", "v").first()[0] == hashlib.sha256(b"1.250000000;0.500000000").hexdigest()
    a, b = (sorted(r[0] for r in audit.hash_sample(d, "id", 10).collect()) for d in (spark.range(100), spark.range(100).repartition(5)))
    assert a == b and len(a) == 10
    verdicts = audit.score_forecasts(spark.createDataFrame([("a", 1.0, 0.0, 2.0), ("b", 1.0, 0.0, 2.0), ("c", 1.0, None, None)], "k string, forecast double, low double, high double"), spark.createDataFrame([("a", 1.5), ("b", 3.0), ("c", 1.0)], "k string, value double"), "k")
    assert {r.k: r.verdict for r in verdicts.collect()} == {"a": "held", "b": "not held", "c": "not evaluable"}
