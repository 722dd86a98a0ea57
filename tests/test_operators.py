"""Hand-worked tables of the operators over filings, and identities that must hold whatever the data."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from ratewright.functions import stats
from ratewright.operators import influence, panel, peers, rates, screen, sectors, stability
from ratewright.operators.derive import deduplicated, derived, size_band, with_peer_keys
from ratewright.shared import cut

COLUMNS = "id long, establishment_id long, ein string, company_name string, state string, naics_code long, year_filing_for int, annual_average_employees double, total_hours_worked double, no_injuries_illnesses double, total_deaths double, total_dafw_cases double, total_djtr_cases double, total_other_cases double, total_dafw_days double, total_djtr_days double"


def filing(i, est=None, year=2024, emp=100.0, hours=200_000.0, box=1.0, d=0.0, dafw=2.0, djtr=1.0, other=1.0, naics=325199, ein="E", name="N", state="S"):
    return (i, i if est is None else est, ein, name, state, naics, year, emp, hours, box, d, dafw, djtr, other, 7.0 * (dafw or 0), 4.0 * (djtr or 0))


def frame(spark, rows):
    return derived(spark.createDataFrame(rows, COLUMNS))


def sample(spark, seed=1, n=1200):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        emp = r.choice([None, 0.0, 0.5, float(r.randint(1, 2000))])  if r.random() < 0.1 else float(r.randint(1, 2000))
        hours = None if r.random() < 0.02 else round(float(emp or 50) * r.choice([10.0, 119.9, 120.0, 1800.0, 2000.0, 2100.0, 4500.0, 4500.5, 9000.0]), 2)
        rows.append(filing(i, r.randrange(300), r.choice([2021, 2022, 2023, 2024]), emp, hours, r.choice([1.0, 2.0, None]), 0.0, r.choice([0.0, 1.0, 2.0, -1.0, None]) if r.random() < 0.1 else float(r.randint(0, 6)), float(r.randint(0, 2)), 0.0, r.choice([325199, 3251, 236115, 23, 622110])))
    return screen.screened(deduplicated(frame(spark, rows)))


def test_derived_fields(spark):
    a, b = frame(spark, [filing(1), filing(2, emp=0.0, hours=0.0, dafw=0.0, djtr=0.0, other=0.0, naics=23)]).orderBy("id").collect()
    assert (a.recordable_cases, a.dart_cases, a.hours_per_employee, a.trir, a.dart_rate, a.naics3) == (4, 3, 2000, 4.0, 3.0, "325")
    assert (b.hours_per_employee, b.trir, b.naics3, b.naics2) == (None, None, None, "23")


def test_last_amendment_wins(spark):
    rows = [filing(1, 100, hours=1000.0), filing(7, 100, hours=2000.0), filing(3, 200, hours=3000.0), filing(None, 300, hours=1.0), filing(9, 300, hours=2.0)]
    got = {r.establishment_id: r.total_hours_worked for r in deduplicated(frame(spark, rows)).collect()}
    assert got == {100: 2000, 200: 3000, 300: 1.0}


@pytest.mark.parametrize(("emp", "hours", "flags"), [
    (10.0, 20000.0, []), (10.0, 50000.0, ["high"]), (10.0, 500.0, ["low"]), (1.0, 4500.0, []), (1.0, 4500.5, ["high"]), (1.0, 120.0, []), (1.0, 119.9, ["low"]), (0.5, 900.0, ["employees_missing"]), (10.0, None, ["hours_missing"]), (None, 1000.0, ["employees_missing"]), (float("inf"), 1000.0, ["employees_missing"]), (10.0, float("nan"), ["hours_missing"]),
])
def test_flags(spark, emp, hours, flags):
    row = screen.screened(frame(spark, [filing(1, emp=emp, hours=hours)])).first()
    fired = [f.removeprefix("flag_").removeprefix("hours_per_employee_") for f in screen.FLAGS if row[f]]
    assert fired == flags and row.implausible == bool(flags)


def test_counts_and_checkbox(spark):
    rows = [filing(1, dafw=-1.0), filing(2, box=2.0), filing(3, box=1.0, dafw=0.0, djtr=0.0, other=0.0), filing(4, dafw=None)]
    got = {r.id: r for r in screen.screened(frame(spark, rows)).collect()}
    assert [got[i].flag_negative_counts for i in (1, 2, 3, 4)] == [True, False, False, True]
    assert [got[i].flag_no_injury_contradiction for i in (1, 2, 3, 4)] == [False, True, True, False]
    assert not got[2].implausible
    assert {r.id: r.implausible for r in screen.screened(frame(spark, rows), screen.Bounds(contradiction_counts=True)).collect()}[2]


def test_bounds_are_checked():
    for low, high in ((0, 100), (200, 100), (100, 9000)):
        with pytest.raises(ValueError):
            screen.Bounds(low, high)


def test_rules_agree_with_the_screen(spark):
    df = sample(spark)
    ruled = screen.check_filings(df.drop(*screen.FLAGS, "implausible"))
    key = lambda r: tuple(r[c] for c in ("id", *screen.FLAGS, "implausible"))
    assert sorted(map(key, df.collect())) == sorted(map(key, ruled.collect()))
    odd = [filing(1, hours=None), filing(2, dafw=-1.0), filing(3, box=2.0), filing(4, dafw=None, box=2.0), filing(5, hours=float("nan")), filing(6, hours=1.0)]
    for bounds in (screen.Bounds(), screen.Bounds(50, 8000, True)):
        a, b = screen.screened(frame(spark, odd), bounds), screen.check_filings(frame(spark, odd), bounds)
        assert sorted(map(key, a.collect())) == sorted(map(key, b.collect()))
        assert all(len(r.messages) == sum(r[f] for f in screen.FLAGS) for r in b.collect())
    with pytest.raises(TypeError):
        screen.Bounds(nonsense=1)
    more = (*screen.FINDINGS, screen.Finding("flag_large", "all_cases > 1000", False, screen.ALWAYS, "Over a thousand cases."))
    assert "flag_large" in screen.check_filings(df.drop(*screen.FLAGS, "implausible"), findings=more).columns


def test_one_bad_filing(spark):
    rows = [filing(i) for i in range(1000)] + [filing(1000, hours=2e11)]
    s = rates.summarise(screen.screened(frame(spark, rows))).first()
    assert s.aggregate_trir_unscreened < 0.01 and s.aggregate_trir_screened == pytest.approx(4.0) and s.n_implausible == 1 and s.ratio_screened_to_unscreened > 100


def test_years_add_up_to_all(spark):
    df = sample(spark)
    by, all_ = rates.summarise(df, "year_filing_for").collect(), rates.summarise(df).first()
    for c in ("n_filings", "n_implausible", "hours_total", "cases_total"):
        assert sum(r[c] for r in by) == pytest.approx(all_[c])


def test_grid_is_the_screen_under_each_pair(spark):
    df = sample(spark)
    grid = {r.label: r for r in rates.sensitivity_grid(df).collect()}
    assert len(grid) == 25
    for low, high in ((100, 3500), (120, 4500), (400, 6000)):
        s = rates.summarise(screen.screened(df.drop(*screen.FLAGS, "implausible"), screen.Bounds(low, high))).first()
        g = grid[f"{low}-{high}"]
        assert g.n_implausible == s.n_implausible and g.trir_screened == pytest.approx(s.aggregate_trir_screened)


def test_size_bands(spark):
    edge = [None, 0.5, 1, 19.9, 20, 49, 50, 99, 100, 249, 250, 499, 500, 999, 1000, 5e6]
    df = spark.createDataFrame([(float(e) if e is not None else None,) for e in edge], "e double")
    assert [r[0] for r in df.select(size_band(F.col("e"))).collect()] == [None, None, "001-019", "001-019", "020-049", "020-049", "050-099", "050-099", "100-249", "100-249", "250-499", "250-499", "500-999", "500-999", "1000+", "1000+"]
    with pytest.raises(ValueError):
        size_band(F.col("e"), (1, 2), ("a",))


def test_peer_keys_and_positions(spark):
    rows = [filing(i, emp=30.0, hours=60_000.0, dafw=float(i), djtr=0.0, other=0.0) for i in range(11)]
    df = screen.screened(frame(spark, rows))
    assert {r.peer_group for r in with_peer_keys(df).collect()} == {"325|020-049"}
    table = peers.percentile_table(df, least=5)
    row = table.first()
    assert row.p50 == pytest.approx(200_000 * 5 / 60_000) and row.publishable
    placed = {r.id: r.band for r in peers.peer_position(df, table).collect()}
    assert placed[0] == "below p10" and placed[5] == "p50 to p75" and placed[10] == "p95 and above"
    lower = {r.id: r.band for r in peers.peer_position(df, table, upper=False).collect()}
    assert lower[5] == "p25 to p50"
    with pytest.raises(KeyError):
        with_peer_keys(df, 5)


def test_two_by_two(spark):
    rows, k = [], 0
    for est, (a, b) in enumerate([(1, 1), (1, 0), (0, 1), (0, 0)]):
        for year, bad in ((2020, a), (2021, b)):
            rows.append(filing(k := k + 1, est, year, hours=9e9 if bad else 200_000.0))
    rows.append(filing(99, 50, 2020))
    got = {r.pair: r for r in panel.transitions(panel.flag_panel(screen.screened(frame(spark, rows)))).collect()}
    assert (got["pooled"].n11, got["pooled"].n10, got["pooled"].n01, got["pooled"].n00, got["pooled"].odds_ratio) == (1, 1, 1, 1, 1.0)
    k = spark.range(1).select(panel.kappa(*(F.lit(x) for x in (40, 10, 10, 40)))).first()[0]
    assert k == pytest.approx(0.6)


def test_permutation_deals_as_many_flags(spark):
    df = sample(spark, 5, 3000)
    values = [r.odds_ratio for r in panel.permutation_null(panel.flag_panel(df), 40).collect()]
    assert len(values) == 40 and 0.5 < sum(values) / 40 < 1.6
    again = [r.odds_ratio for r in panel.permutation_null(panel.flag_panel(df), 40).collect()]
    tight = [r.odds_ratio for r in panel.permutation_null(panel.flag_panel(df), 40, margin=-1.0).collect()]  # too few near the share: all are ranked
    assert sorted(map(str, tight)) == sorted(map(str, values))
    assert sorted(values) == sorted(again)


@pytest.mark.parametrize("margin", [6.0, 0.0, -1.0])
def test_permutation_against_ranks_of_all(spark, monkeypatch, margin):
    """Each round's flags by ranking all digests; with a usual margin no table holds a row for each flagged filer of each round."""
    rows = [(e, y, int((e * 7 + y) % 10 < share)) for y, share in ((2020, 5), (2021, 4), (2022, 0)) for e in range(6000) if (e + y) % 6]
    df, times, written = spark.createDataFrame(rows, "establishment_id long, year int, flag int"), 4, []

    def counted(df, tag):
        out = cut(df, tag)
        written.append(0 if tag == "pairs" else out.count())
        return out

    monkeypatch.setattr(panel, "cut", counted)
    found = {r.rep: r.odds_ratio for r in panel.permutation_null(df, times, margin=margin).collect()}
    assert sorted(found) == list(range(times))
    for rep in range(times):
        flagged = {}
        for y in (2020, 2021, 2022):
            filers = sorted((hashlib.md5(f"20260909|{e}|{y}|{rep}".encode()).hexdigest()[:13], e) for e, x, _ in rows if x == y)
            k = sum(f for _, x, f in rows if x == y)
            flagged[y] = {e: i < k for i, (_, e) in enumerate(filers)}
        cells = [(flagged[y][e], flagged[y + 1][e]) for y in (2020, 2021) for e in flagged[y] if e in flagged[y + 1]]
        n = {c: cells.count(c) for c in set(cells)}
        assert found[rep] == pytest.approx(n[True, True] * n[False, False] / (n[True, False] * n[False, True]))
    if margin == 6.0:
        assert sum(written) < times * sum(f for _, _, f in rows) / 2


def test_ranks_and_correlation(spark):
    df = spark.createDataFrame([(1.0, 3.0), (2.0, 1.0), (2.0, 5.0), (4.0, 5.0)], "a double, b double")
    ranked = df.select("a", "b", stability.average_rank("a").alias("ra"), stability.average_rank("b").alias("rb"))
    assert sorted(r.ra for r in ranked.collect()) == [1, 2.5, 2.5, 4]
    rho = ranked.agg(stability.spearman("ra", "rb")).first()[0]
    assert rho == pytest.approx(0.5)
    assert ranked.withColumn("rb", F.lit(1.0)).agg(stability.spearman("ra", "rb")).first()[0] is None


def test_decomposition_adds_up(spark):
    for r in influence.kitagawa(peers.percentile_table(sample(spark, 2), least=1)).collect():
        assert r.within_effect + r.composition_effect == pytest.approx(r.matched_change, abs=1e-10)


def test_removal_is_removal(spark):
    df = sample(spark, 3, 400)
    loo = {r.id: r for r in influence.leave_one_filing_out(df).collect()}
    good = [r for r in df.filter("not implausible").collect()]
    for r in good[:25]:
        rest = [x for x in good if x.year_filing_for == r.year_filing_for and x.id != r.id]
        assert loo[r.id].rate_without == pytest.approx(200_000 * sum(x.recordable_cases for x in rest) / sum(x.total_hours_worked for x in rest))
    sides = influence.removal_by_sides(df.filter("not implausible"), "year_filing_for", "id", "recordable_cases", "total_hours_worked")
    assert all(x.rate_without == pytest.approx(loo[x.id].rate_without) for x in sides.collect())


def test_accounting_adds_up(spark):
    row = spark.range(1).select(*(v.alias(k) for k, v in influence.accounting(F.lit(50.0), F.lit(1e6), F.lit(5.0), F.lit(4e5)).items())).first()
    assert row.numerator_effect + row.denominator_effect == pytest.approx(row.joint_change)
    with pytest.raises(ValueError):
        influence.scaled_rate(F.lit(1), F.lit(1), F.lit(1), 0.5)


def test_exclusions(spark):
    df = sample(spark, 4, 500)
    got = {(r.year, r.scenario): r.rate for r in influence.exclusion_scenarios(df).collect()}
    good = [r for r in df.filter("not implausible").collect() if r.year_filing_for == 2024]
    good.sort(key=lambda r: (-r.total_hours_worked, r.id))
    assert got[(2024, "without_top_2")] == pytest.approx(200_000 * sum(r.recordable_cases for r in good[2:]) / sum(r.total_hours_worked for r in good[2:]))
    small = [r for r in good if r.annual_average_employees <= 100]
    assert got[(2024, "without_above_100")] == pytest.approx(200_000 * sum(r.recordable_cases for r in small) / sum(r.total_hours_worked for r in small))


def test_intervals():
    assert stats.garwood(0) == pytest.approx((0, 3.6889), abs=1e-3)
    assert stats.garwood(10) == pytest.approx((4.7954, 18.3904), abs=1e-3)
    for k in (0, 1, 3, 50, 2000):
        low, high = stats.garwood(k, 0.9)
        assert stats.poisson_cdf(k, high) == pytest.approx(0.05) and (k == 0 or 1 - stats.poisson_cdf(k - 1, low) == pytest.approx(0.05))
    assert stats.clopper_pearson(3, 20) == pytest.approx((0.0321, 0.3789), abs=1e-3)
    assert stats.chi2_tail(9.4877, 4) == pytest.approx(0.05, abs=1e-4)
    assert stats.chi2_tail(3.8415, 1) == pytest.approx(0.05, abs=1e-4)


def test_wilson_and_gini(spark):
    low, high = spark.range(1).select(*stats.wilson(F.lit(10), F.lit(100))).first()
    assert (low, high) == pytest.approx((0.0552, 0.1744), abs=1e-3)
    even = spark.createDataFrame([("a", 10.0, 1.0), ("b", 20.0, 2.0)], "g string, n double, k double")
    assert stats.gini(stats.lorenz(even, "k", "n", "g")).first()[0] == pytest.approx(0)
    assert sectors.wilson_by(sample(spark), "naics2").count() == 3


def test_forecast(spark):
    series = spark.createDataFrame([("a", y, float(v)) for y, v in zip(range(2016, 2025), [5, 4, 6, 5, 5, 4, 6, 5, 4], strict=True)], "k string, y int, v double")
    row = stability.rolling_forecast(series, "k", "y", "v").first()
    assert row.forecast == pytest.approx(5.0) and row.n_tested == 6 and row.low < 5 < row.high
    row = stability.rolling_forecast(series.withColumn("v", F.col("v") / 10), "k", "y", "v", transform="logit").first()
    assert 0 < row.low < row.forecast < row.high < 1


def test_rates_skip_missing_parts(spark):
    df = screen.screened(frame(spark, [filing(1, dafw=None), filing(2)]))
    row = rates.rates(df).first()
    assert row.trir_numerator == 6 and row.trir_numerator_screened == 4 and math.isclose(row.trir_unscreened, 200_000 * 6 / 400_000)


def test_registered_with_all_tops_and_permutations(spark):
    import __spark_entry__ as entry

    data = "/root/testdata/sf0.001"
    found = {x.top_n: x for x in entry.queries()["threshold_rank_trim"](spark, data).collect()}
    assert sorted(found) == [1, 10, 100, 1000, 10000]
    assert {x.rep for x in entry.queries()["permutation_null"](spark, data).collect()} == set(range(200))


def test_rank_trim_without_hours_left(spark):
    rows = [(i, 0.1 + i / 3, float(i % 4)) for i in range(15)] + [(100, 0.0, 2.0), (101, None, 1.0)]
    df = spark.createDataFrame(rows, "id long, total_hours_worked double, recordable_cases double")
    found = {x.top_n: x.trir for x in rates.rank_trim(df, (1, 14, 15, 16, 1000)).collect()}
    assert found[14] == pytest.approx(200000 * (0 + 2 + 1) / 0.1)
    assert found[1] is not None and found[15] is None and found[16] is None and found[1000] is None


def test_rank_trim_where_one_filing_holds_nearly_all_hours(spark):
    """All - top would leave noise: what is left is a sum of its own."""
    rows = [(i, 0.01 * (i + 1), 1.0) for i in range(20)] + [(100, 1e17, 2.0), (101, None, 1.0)]
    found = {x.top_n: x.trir for x in rates.rank_trim(spark.createDataFrame(rows, "id long, total_hours_worked double, recordable_cases double"), (1, 20, 21, 22)).collect()}
    assert found[1] == pytest.approx(200000 * 21 / 2.1) and found[20] == pytest.approx(200000 * 2 / 0.01)
    assert found[21] is None and found[22] is None
