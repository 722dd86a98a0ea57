"""Queries over the filings view, each with its SQL. Doubles are rounded to six places on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewright.functions import exact, stats
from ratewright.models import counts
from ratewright.models import exact as exact_models
from ratewright.operators import expectations as ex
from ratewright.operators import detectability, graph, influence, panel, peers, rates, review, screen, sectors, stability
from ratewright.operators.derive import deduplicated, derived, with_peer_keys
from ratewright.operators.merge import one_to_one
from ratewright.shared import cut
from ratewright.sources.manifest import digest, listing, manifest
from ratewright.sources import naics
from ratewright.sources.surrogate import SQL as VIEW
from ratewright.sources.surrogate import filings

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


#: Sums of hours, which have two places in the data.
HOURS = {"hours_total", "hours_unscreened", "hours_screened", "flagged_hours", "screened_hours", "hours", "removed_hours", "total_hours_worked"}


def places(name: str) -> int:
    return 2 if name in HOURS else 6


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, places(c)).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t in ("int", "bigint") else F.col(c) for c, t in df.dtypes))


def query(sql: str | None = None, more: str = "", plain: bool = False) -> Callable[[Query], Query]:
    """Registers a query; `sql` is a SELECT over the view's steps, `more` further steps. plain: nothing is rounded."""

    def add(f: Query) -> Query:
        name = f.__name__
        QUERIES[name] = f if plain else lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            ORACLE[name] = f"WITH {'RECURSIVE ' if ' AS i, CAST(' in more else ''}{VIEW.strip()}{', ' + more.strip() if more else ''} {sql.strip()}"
        return f

    return add


#: Tables that base() has written, by application and by the files that they were made of.
WRITTEN: dict[tuple[str, ...], DataFrame] = {}


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived, deduplicated and screened filings: a table that all queries of a session over the same files share.

    It is written once, to the shared folder, and anew as soon as a file of its tables has come, gone or changed.
    """
    key = (spark.sparkContext.applicationId, *listing(spark, *(f"{sf_dir}/{t}.parquet" for t in ("orders", "lineitem", "customer"))))
    if key not in WRITTEN:
        WRITTEN[key] = cut(screen.screened(deduplicated(derived(filings(spark, sf_dir)))), "screened")
    return WRITTEN[key]


def table(spark: SparkSession, sf_dir: str, by: tuple[str, ...] = ("year_filing_for",), cuts: bool = True) -> DataFrame:
    return peers.percentile_table(base(spark, sf_dir), by, cuts=cuts)


def r(expr: str, name: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), {places(name)}) AS {name}"


def n(expr: str, name: str) -> str:
    return f"CAST({expr} AS BIGINT) AS {name}"


SUM = lambda c, w="": f"coalesce(sum({c}){' FILTER (' + w + ')' if w else ''}, 0)"
SUMMARY = ", ".join([
    n("count(*)", "n_filings"), n("count(*) FILTER (bad)", "n_implausible"), r("avg(CASE WHEN bad THEN 1.0 ELSE 0.0 END)", "implausible_share"), r(SUM("hours"), "hours_total"),
    r(f"{SUM('hours', 'bad')} / nullif({SUM('hours')}, 0)", "hours_share_implausible"), r(SUM("cases"), "cases_total"), r(f"{SUM('cases', 'bad')} / nullif({SUM('cases')}, 0)", "cases_share_implausible"),
    r(f"200000.0 * {SUM('cases')} / nullif({SUM('hours')}, 0)", "aggregate_trir_unscreened"), r(f"200000.0 * (sum(cases) FILTER (NOT bad)) / nullif({SUM('hours', 'NOT bad')}, 0)", "aggregate_trir_screened"),
    r(f"(200000.0 * (sum(cases) FILTER (NOT bad)) / nullif({SUM('hours', 'NOT bad')}, 0)) / nullif(200000.0 * {SUM('cases')} / nullif({SUM('hours')}, 0), 0)", "ratio_screened_to_unscreened"),
    r("quantile_cont(trir, 0.5) FILTER (NOT bad)", "median_trir_screened"),
])
FLAG = {"flag_hours_missing": "f_hours", "flag_employees_missing": "f_emp", "flag_negative_counts": "f_neg", "flag_hours_per_employee_high": "f_high", "flag_hours_per_employee_low": "f_low", "flag_no_injury_contradiction": "f_box"}
PCT = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95}
CELLS = f"""
cells AS (
  SELECT year_filing_for, naics3, band, count(*) AS n, count(trir) AS m, avg(CASE WHEN cases = 0 THEN 1.0 ELSE 0.0 END) AS zero, sum(hours) AS h, sum(cases) AS c,
         CASE WHEN sum(hours) > 0 THEN 200000.0 * sum(cases) / sum(hours) END AS rate, {', '.join(f'quantile_cont(trir, {q}) AS {p}' for p, q in PCT.items())}, count(trir) >= 30 AS pub
  FROM keyed WHERE NOT bad AND band IS NOT NULL AND naics3 IS NOT NULL AND year_filing_for IS NOT NULL GROUP BY ALL)"""
YEARS = "yrs AS (SELECT year_filing_for AS y0, lead(year_filing_for) OVER (ORDER BY year_filing_for) AS y1 FROM (SELECT DISTINCT year_filing_for FROM keyed)), pairs AS (SELECT * FROM yrs WHERE y1 IS NOT NULL)"


@query("SELECT id, establishment_id, year_filing_for, cases AS recordable_cases, dart AS dart_cases, hpe AS hours_per_employee, trir, dart_rate, naics2, naics3, naics4 FROM derived", plain=True)
def harmonise_derive(spark, sf_dir):
    return derived(filings(spark, sf_dir)).select("id", "establishment_id", "year_filing_for", "recordable_cases", "dart_cases", "hours_per_employee", "trir", "dart_rate", "naics2", "naics3", "naics4")


@query(f"SELECT id, establishment_id, {n('year_filing_for', 'year_filing_for')}, {r('hours', 'total_hours_worked')} FROM latest")
def dedup_latest(spark, sf_dir):
    return deduplicated(derived(filings(spark, sf_dir))).select("id", "establishment_id", "year_filing_for", "total_hours_worked")


@query(f"SELECT id, {', '.join(f'{v} AS {k}' for k, v in FLAG.items())}, bad AS implausible FROM screened")
def screen_flags(spark, sf_dir):
    return base(spark, sf_dir).select("id", *screen.FLAGS, "implausible")


@query(f"SELECT id, {', '.join(f'{v} AS {k}' for k, v in FLAG.items())}, bad OR f_box AS implausible, {n(' + '.join(f'CAST({v} AS INT)' for v in FLAG.values()), 'n_messages')} FROM screened")
def rule_engine_flags(spark, sf_dir):
    rows = deduplicated(derived(filings(spark, sf_dir)))
    return screen.check_filings(rows, screen.Bounds(contradiction_counts=True)).select("id", *screen.FLAGS, "implausible", F.size("messages").alias("n_messages"))


@query(f"SELECT {SUMMARY} FROM screened")
def screen_summary_pooled(spark, sf_dir):
    return rates.summarise(base(spark, sf_dir))


@query(f"SELECT {n('year_filing_for', 'year_filing_for')}, {SUMMARY} FROM screened GROUP BY year_filing_for")
def screen_by_year(spark, sf_dir):
    return rates.summarise(base(spark, sf_dir), "year_filing_for")


@query(f"SELECT naics3, {SUMMARY} FROM screened WHERE naics3 IS NOT NULL GROUP BY naics3")
def screen_by_naics(spark, sf_dir):
    return rates.summarise(base(spark, sf_dir), "naics3")


@query(f"SELECT naics2, {SUMMARY} FROM screened WHERE naics2 IS NOT NULL GROUP BY naics2")
def screen_by_naics2(spark, sf_dir):
    return rates.summarise(base(spark, sf_dir), "naics2")


@query(" UNION ALL ".join(f"SELECT '{k}' AS flag, {n(f'count(*) FILTER ({v})', 'n')}, {r(f'avg(CASE WHEN {v} THEN 1.0 ELSE 0.0 END)', 'share')}, {r(SUM('hours', v), 'hours')}, {r(SUM('hours', v) + '/ nullif(' + SUM('hours') + ', 0)', 'hours_share')} FROM screened" for k, v in FLAG.items()))
def flag_prevalence(spark, sf_dir):
    return rates.flag_prevalence(base(spark, sf_dir))


GRID = """
bounds AS (SELECT lo, hi FROM (VALUES (100), (120), (200), (300), (400)) a(lo), (VALUES (3500), (4000), (4500), (5000), (6000)) b(hi)),
grid AS (
  SELECT lo, hi, count(*) AS n, count(*) FILTER (x) AS k, coalesce(sum(hours), 0) AS h, coalesce(sum(cases), 0) AS c, coalesce(sum(hours) FILTER (x), 0) AS fh, coalesce(sum(cases) FILTER (x), 0) AS fc
  FROM (SELECT lo, hi, hours, cases, f_hours OR f_emp OR f_neg OR coalesce(hpe > hi, false) OR coalesce(hpe < lo, false) AS x FROM screened, bounds) GROUP BY lo, hi),
cell AS (SELECT *, lo || '-' || hi AS label, 200000.0 * c / h AS raw, 200000.0 * (c - fc) / (h - fh) AS kept, k / n AS share FROM grid)"""


@query(f"SELECT label, {r('lo', 'low')}, {r('hi', 'high')}, {n('n', 'n_filings')}, {n('k', 'n_implausible')}, {r('h', 'hours_total')}, {r('c', 'cases_total')}, {r('fh', 'flagged_hours')}, {r('fc', 'flagged_cases')}, {r('raw', 'trir_unscreened')}, {r('kept', 'trir_screened')}, {r('share', 'implausible_share')}, {r('kept / raw', 'ratio_screened_to_unscreened')} FROM cell", GRID)
def sensitivity_grid(spark, sf_dir):
    return rates.sensitivity_grid(base(spark, sf_dir))


@query(f"SELECT label, {r('lo', 'low')}, {r('hi', 'high')}, {n('k', 'n_implausible')}, {r('fh', 'flagged_hours')}, {r('fc', 'flagged_cases')}, {r('h - fh', 'screened_hours')}, {r('c - fc', 'screened_cases')}, {r('kept - dk', 'trir_minus_default')}, {r('100 * (kept / dk - 1)', 'trir_pct_from_default')}, {r('share / ds', 'share_over_default')}, {n('row_number() OVER (ORDER BY round(kept, 9) DESC, lo, hi)', 'trir_rank')} FROM cell, (SELECT kept AS dk, share AS ds FROM cell WHERE lo = 120 AND hi = 4500)", GRID)
def threshold_cells(spark, sf_dir):
    return rates.threshold_cells(rates.sensitivity_grid(base(spark, sf_dir)))


@query(f"SELECT bound, {r('a', 'value_from')}, {r('b', 'value_to')}, {n('dk', 'filings')}, {r('dh', 'hours')}, {r('dc', 'cases')}, {r('200000.0 * dc / nullif(dh, 0)', 'trir')} FROM (SELECT bound, lag(v) OVER w AS a, v AS b, abs(k - lag(k) OVER w) AS dk, abs(fh - lag(fh) OVER w) AS dh, abs(fc - lag(fc) OVER w) AS dc FROM (SELECT 'low' AS bound, lo AS v, k, fh, fc FROM cell WHERE hi = 4500 UNION ALL SELECT 'high', hi, k, fh, fc FROM cell WHERE lo = 120) WINDOW w AS (PARTITION BY bound ORDER BY v)) WHERE a IS NOT NULL", GRID)
def marginal_bands(spark, sf_dir):
    return rates.marginal_bands(rates.sensitivity_grid(base(spark, sf_dir)))


TOPS = (1, 10, 100, 1000, 10000)
RANKED = "ranked AS (SELECT *, row_number() OVER (ORDER BY hours DESC, id) AS rk FROM screened WHERE hours IS NOT NULL), tops AS (SELECT * FROM (VALUES (1), (10), (100), (1000), (10000)) t(top)), tot AS (SELECT count(*) AS n, sum(hours) AS h, sum(cases) AS c FROM screened), held AS (SELECT top, sum(hours) FILTER (rk <= top) AS hh, coalesce(sum(cases) FILTER (rk <= top), 0) AS cc FROM tops, ranked GROUP BY top)"


@query(f"SELECT {n('top', 'top_n')}, {r('hh / h', 'hours_share')}, {r('cc / c', 'cases_share')} FROM held, tot", RANKED)
def hours_concentration(spark, sf_dir):
    return rates.hours_concentration(base(spark, sf_dir), TOPS)


@query(f"SELECT {n('top', 'top_n')}, {r('CASE WHEN h - hh > 1e-6 THEN 200000.0 * (c - cc) / (h - hh) END', 'trir')}, {r('top / n', 'share_of_filings')} FROM held, tot", RANKED)
def threshold_rank_trim(spark, sf_dir):
    return rates.rank_trim(base(spark, sf_dir))


@query(f"SELECT id, {n('year_filing_for', 'year_filing_for')}, {r('hours', 'total_hours_worked')}, {r('hpe', 'hours_per_employee')}, {r('cases', 'recordable_cases')} FROM screened WHERE f_high ORDER BY hours DESC, id LIMIT 50")
def top50_high_hpe(spark, sf_dir):
    return sectors.top_high(base(spark, sf_dir)).select("id", "year_filing_for", "total_hours_worked", "hours_per_employee", "recordable_cases")


@query(f"SELECT {n('year_filing_for', 'year_filing_for')}, {n('count(*)', 'n')}, {r('avg(CASE WHEN cases = 0 THEN 1.0 ELSE 0.0 END)', 'zero_share')} FROM screened WHERE NOT bad GROUP BY year_filing_for")
def zero_share_by_year(spark, sf_dir):
    return rates.zero_share(base(spark, sf_dir), "year_filing_for")


NUM = {"trir": "coalesce(deaths,0)+coalesce(dafw,0)+coalesce(djtr,0)+coalesce(other,0)", "dart": "coalesce(dafw,0)+coalesce(djtr,0)", "ltir": "coalesce(dafw,0)", "severity": "coalesce(dafw_days,0)+coalesce(djtr_days,0)"}
RATE_COLUMNS = ", ".join([n("count(*)", "n_filings"), n("count(*) FILTER (NOT bad)", "n_screened"), r(SUM("hours"), "hours_unscreened"), r(SUM("hours", "NOT bad"), "hours_screened")] + [
    x for k, v in NUM.items() for x in (r(f"sum({v})", f"{k}_numerator"), r(SUM(v, "NOT bad"), f"{k}_numerator_screened"), r(f"200000.0 * sum({v}) / nullif({SUM('hours')}, 0)", f"{k}_unscreened"), r(f"200000.0 * {SUM(v, 'NOT bad')} / nullif({SUM('hours', 'NOT bad')}, 0)", f"{k}_screened"), r(f"(200000.0 * {SUM(v, 'NOT bad')} / nullif({SUM('hours', 'NOT bad')}, 0)) / nullif(200000.0 * sum({v}) / nullif({SUM('hours')}, 0), 0)", f"{k}_ratio"))
])


@query(f"SELECT {n('year_filing_for', 'year_filing_for')}, {RATE_COLUMNS} FROM screened GROUP BY year_filing_for")
def rates_by_year(spark, sf_dir):
    return rates.rates(base(spark, sf_dir), "year_filing_for")


@query(f"SELECT {RATE_COLUMNS} FROM screened")
def rates_pooled(spark, sf_dir):
    return rates.rates(base(spark, sf_dir))


@query(f"SELECT band AS size_band, {n('count(*)', 'n')}, {r('avg(CASE WHEN cases = 0 THEN 1.0 ELSE 0.0 END)', 'zero_share')}, {r('avg(cases)', 'mean_cases')}, {r('var_pop(cases)', 'var_cases')}, {r('200000.0 * sum(cases) / sum(hours)', 'aggregate_trir')}, {r('quantile_cont(trir, 0.5)', 'median_trir')}, {r('var_pop(cases) / nullif(avg(cases), 0)', 'variance_to_mean')}, {n('''CASE band WHEN '001-019' THEN 0 WHEN '020-049' THEN 1 WHEN '050-099' THEN 2 WHEN '100-249' THEN 3 WHEN '250-499' THEN 4 WHEN '500-999' THEN 5 ELSE 6 END''', 'band_rank')} FROM keyed WHERE NOT bad AND band IS NOT NULL GROUP BY band")
def size_band_effects(spark, sf_dir):
    return rates.size_effects(base(spark, sf_dir))


@query(f"SELECT CASE WHEN k >= 10 THEN '10+' ELSE CAST(k AS VARCHAR) END AS count, {n('k', 'sort_key')}, {n('count(*)', 'n')} FROM (SELECT CAST(least(cases, 10) AS BIGINT) AS k FROM screened WHERE NOT bad) GROUP BY k")
def count_histogram(spark, sf_dir):
    return rates.case_histogram(base(spark, sf_dir))


@query(f"SELECT {n('b', 'bin')}, {n('count(*)', 'n')} FROM (SELECT least(floor((log10(greatest(0.1, least(hpe, 1e8))) + 1) * 10), 89) AS b FROM screened WHERE hpe > 0) GROUP BY b")
def hours_histogram(spark, sf_dir):
    return rates.hours_histogram(base(spark, sf_dir))


CELL_COLUMNS = f"naics3, band AS size_band, {n('n', 'n')}, {n('m', 'n_with_metric')}, {r('zero', 'zero_share')}, {r('h', 'hours_total')}, {r('c', 'cases_total')}, {r('rate', 'aggregate_trir')}, {', '.join(r(p, p) for p in PCT)}, pub AS publishable"


@query(f"SELECT {n('year_filing_for', 'year_filing_for')}, {CELL_COLUMNS} FROM cells", CELLS)
def peer_percentiles_by_year(spark, sf_dir):
    return table(spark, sf_dir)


@query(f"SELECT {CELL_COLUMNS} FROM cells", CELLS.replace("SELECT year_filing_for, naics3", "SELECT naics3"))
def peer_percentiles_pooled(spark, sf_dir):
    return table(spark, sf_dir, ())


@query(f"SELECT {n('count(*)', 'groups')}, {n('count(*) FILTER (pub)', 'groups_publishable')}, {n('sum(n)', 'filings')}, {n(SUM('n', 'pub'), 'filings_publishable')}, {r('count(*) FILTER (pub) / count(*)', 'share_groups')}, {r(SUM('n', 'pub') + ' / sum(n)', 'share_filings')} FROM cells", CELLS)
def peer_coverage(spark, sf_dir):
    return peers.coverage(table(spark, sf_dir, cuts=False))


@query(f"""
SELECT id, status, CASE WHEN status = 'placed' THEN CASE {' '.join(f"WHEN trir >= {p} THEN '{t}'" for p, t in reversed(list(zip(PCT, ['p10 to p25', 'p25 to p50', 'p50 to p75', 'p75 to p90', 'p90 to p95', 'p95 and above'], strict=True))))} ELSE 'below p10' END END AS band
FROM (SELECT k.id, k.trir, {', '.join(f'c.{p}' for p in PCT)}, CASE WHEN bad THEN 'excluded' WHEN k.trir IS NULL THEN 'no_rate' WHEN k.band IS NULL OR k.naics3 IS NULL THEN 'no_peer_group' WHEN NOT coalesce(pub, false) THEN 'not_publishable' ELSE 'placed' END AS status
      FROM keyed k LEFT JOIN cells c ON k.year_filing_for = c.year_filing_for AND k.naics3 = c.naics3 AND k.band = c.band)""", CELLS)
def peer_position(spark, sf_dir):
    rows = base(spark, sf_dir)
    return peers.peer_position(rows, peers.percentile_table(rows))


LONG = "both_ AS (SELECT y0, y1, a.naics3, a.band, a.rate AS r0, b.rate AS r1, a.h AS h0, b.h AS h1, " + ", ".join(f"a.{p} AS {p}_0, b.{p} AS {p}_1" for p in PCT) + ", a.pub AND b.pub AS pub FROM pairs JOIN cells a ON a.year_filing_for = y0 JOIN cells b ON b.year_filing_for = y1 AND a.naics3 = b.naics3 AND a.band = b.band), long_ AS (" + " UNION ALL ".join(f"SELECT y0, y1, '{p}' AS percentile, {p}_0 AS v0, {p}_1 AS v1 FROM both_ WHERE pub" for p in PCT) + ")"
AVG_RANK = lambda v, by: f"rank() OVER (PARTITION BY {by} ORDER BY {v}) + (count(*) OVER (PARTITION BY {by}, {v}) - 1) / 2.0"
PUB_PAIRS = "pubyears AS (SELECT y AS y0, lead(y) OVER (ORDER BY y) AS y1 FROM (SELECT DISTINCT year_filing_for AS y FROM cells WHERE pub)), pairs AS (SELECT * FROM pubyears WHERE y1 IS NOT NULL)"


@query(f"""SELECT {n('y0', 'year_from')}, {n('y1', 'year_to')}, percentile, {n('count(*)', 'n_matched_groups')},
  {r('CASE WHEN var_pop(k0) > 0 AND var_pop(k1) > 0 THEN covar_pop(k0, k1) / (stddev_pop(k0) * stddev_pop(k1)) END', 'spearman_rho')}, {r('quantile_cont(abs(v1 - v0), 0.5)', 'median_abs_change')}, {r('quantile_cont(CASE WHEN v0 > 0 THEN abs(v1 - v0) / v0 END, 0.5)', 'median_abs_rel_change')}
  FROM (SELECT *, {AVG_RANK('v0', 'y0, y1, percentile')} AS k0, {AVG_RANK('v1', 'y0, y1, percentile')} AS k1 FROM long_ WHERE v0 IS NOT NULL AND v1 IS NOT NULL) GROUP BY y0, y1, percentile HAVING count(*) >= 3""", f"{CELLS.replace('>= 30', '>= 10')}, {PUB_PAIRS}, {LONG}")
def band_stability(spark, sf_dir):
    return stability.band_stability(peers.percentile_table(base(spark, sf_dir), least=10))


@query(f"SELECT {n('y0', 'year_from')}, {n('y1', 'year_to')}, {n('na', 'groups_year_from')}, {n('nb', 'groups_year_to')}, {n('nm', 'groups_matched')}, {r('nm / nullif(na, 0)', 'matched_share_of_year_from')} FROM (SELECT y0, y1, (SELECT count(*) FROM cells WHERE pub AND year_filing_for = y0) AS na, (SELECT count(*) FROM cells WHERE pub AND year_filing_for = y1) AS nb, (SELECT count(*) FROM cells a JOIN cells b ON a.naics3 = b.naics3 AND a.band = b.band WHERE a.pub AND b.pub AND a.year_filing_for = y0 AND b.year_filing_for = y1) AS nm FROM pairs)", f"{CELLS}, {PUB_PAIRS}")
def group_persistence(spark, sf_dir):
    return stability.group_persistence(table(spark, sf_dir, cuts=False))


TOTALS = "yt AS (SELECT year_filing_for AS year, count(*) AS n, count(*) FILTER (bad) AS k, coalesce(sum(hours), 0) AS h, coalesce(sum(cases), 0) AS c, coalesce(sum(hours) FILTER (NOT bad), 0) AS gh, coalesce(sum(cases) FILTER (NOT bad), 0) AS gc FROM screened GROUP BY 1), tt AS (SELECT sum(n) AS n, sum(k) AS k, sum(h) AS h, sum(c) AS c, sum(gh) AS gh, sum(gc) AS gc FROM yt)"
POOL = ", ".join([n("n", "n_filings"), n("k", "n_implausible"), r("k / n", "implausible_share"), r("1 - gh / h", "hours_share_implausible"), r("200000.0 * c / h", "trir_unscreened"), r("200000.0 * gc / gh", "trir_screened"), r("(gc / gh) / (c / h)", "ratio_screened_to_unscreened")])


@query(f"SELECT left_out_year, {POOL}, {r('k / n - tk / tn', 'implausible_share_minus_pooled')}, {r('100 * ((gc / gh) / (tgc / tgh) - 1)', 'trir_screened_pct_from_pooled')} FROM (SELECT 'all' AS left_out_year, n, k, h, c, gh, gc FROM tt UNION ALL SELECT CAST(year AS VARCHAR), tt.n - yt.n, tt.k - yt.k, tt.h - yt.h, tt.c - yt.c, tt.gh - yt.gh, tt.gc - yt.gc FROM yt, tt), (SELECT n AS tn, k AS tk, gh AS tgh, gc AS tgc FROM tt)", TOTALS)
def leave_one_year_out(spark, sf_dir):
    return stability.leave_one_year_out(base(spark, sf_dir))


@query(f"SELECT {n('year', 'year')}, {POOL}, {r('k / n - lag(k / n) OVER w', 'implausible_share_change')}, {r('200000.0 * (gc / gh - lag(gc / gh) OVER w)', 'trir_screened_change')}, {r('100 * ((gc / gh) / lag(gc / gh) OVER w - 1)', 'trir_screened_pct_change')} FROM yt WINDOW w AS (ORDER BY year)", TOTALS)
def year_over_year(spark, sf_dir):
    return stability.year_over_year(base(spark, sf_dir))


@query(f"""
SELECT panel, label, {SUMMARY}, {n('min(year_filing_for)', 'year_first')}, {n('max(year_filing_for)', 'year_last')}
FROM (SELECT d.panel, d.label, s.year_filing_for, s.hours, s.cases, s.trir, f_hours OR f_emp OR f_neg OR coalesce(hpe > hi, false) OR coalesce(hpe < lo, false) AS bad FROM screened s,
  (VALUES ('old', 'old', 100, 4000, true), ('new', 'new', 120, 4500, false), ('old_years_sensitivity', 'old_years_100-4000', 100, 4000, true), ('old_years_sensitivity', 'old_years_100-4500', 100, 4500, true), ('old_years_sensitivity', 'old_years_120-4000', 120, 4000, true), ('old_years_sensitivity', 'old_years_120-4500', 120, 4500, true)) d(panel, label, lo, hi, old_only)
  WHERE NOT old_only OR year_filing_for IN (1996, 1997, 1998)) GROUP BY panel, label""")
def reconcile_panels(spark, sf_dir):
    return rates.reconcile_panels(base(spark, sf_dir), (1996, 1997, 1998))


@query(" UNION ALL ".join(["SELECT 'distinct_establishment_ids' AS metric, " + n("count(DISTINCT establishment_id)", "value") + " FROM screened", "SELECT 'filings_with_missing_establishment_id', count(*) FILTER (establishment_id IS NULL) FROM screened"] + [f"SELECT 'establishment_ids_with_multiple_{c}', count(*) FILTER (k > 1) FROM (SELECT count(DISTINCT {c}) AS k FROM screened GROUP BY establishment_id)" for c in ("ein", "company_name", "state")]))
def key_drift(spark, sf_dir):
    return panel.key_drift(base(spark, sf_dir))


@query(f"SELECT {n('y', 'years_present')}, {n('count(*)', 'establishments')} FROM (SELECT count(DISTINCT year_filing_for) AS y FROM screened GROUP BY establishment_id) GROUP BY y")
def panel_coverage(spark, sf_dir):
    return panel.coverage(panel.flag_panel(base(spark, sf_dir)))


PAIRED = YEARS + ", pr AS (SELECT y0, y1, a.bad AS was, b.bad AS is_ FROM pairs JOIN screened a ON a.year_filing_for = y0 JOIN screened b ON b.year_filing_for = y1 AND a.establishment_id = b.establishment_id), cnt AS (SELECT y0 || '-' || y1 AS pair, count(*) FILTER (was AND is_) AS n11, count(*) FILTER (was AND NOT is_) AS n10, count(*) FILTER (NOT was AND is_) AS n01, count(*) FILTER (NOT was AND NOT is_) AS n00 FROM pr GROUP BY 1), alln AS (SELECT * FROM cnt UNION ALL SELECT 'pooled', sum(n11), sum(n10), sum(n01), sum(n00) FROM cnt), tn AS (SELECT pair, CAST(n11 AS DOUBLE) AS n11, CAST(n10 AS DOUBLE) AS n10, CAST(n01 AS DOUBLE) AS n01, CAST(n00 AS DOUBLE) AS n00, CAST(n11 + n10 + n01 + n00 AS DOUBLE) AS nn FROM alln), kk AS (SELECT *, (n11 + n00) / nn AS seen, ((n11 + n10) * (n11 + n01) + (n01 + n00) * (n10 + n00)) / (nn * nn) AS chance FROM tn)"


@query(f"SELECT pair, {', '.join(n(c, c) for c in ('n11', 'n10', 'n01', 'n00'))}, {n('nn', 'n')}, {r('n11 * n00 / nullif(n10 * n01, 0)', 'odds_ratio')}, {r('CASE WHEN chance < 1 THEN (seen - chance) / (1 - chance) END', 'kappa')}, {r('n11 / nullif(n11 + n10, 0)', 'p_flag_after_flag')}, {r('n01 / nullif(n01 + n00, 0)', 'p_flag_after_none')} FROM kk", PAIRED)
def panel_transitions(spark, sf_dir):
    return panel.transitions(panel.flag_panel(base(spark, sf_dir)))


@query(f"SELECT comparison, {n('m', 'n_filers')}, {n('k', 'n_flagged')}, {r('k / nullif(m, 0)', 'flagged_share')}, {r('b', 'baseline_rate')}, {r('(k / nullif(m, 0)) / nullif(b, 0)', 'enrichment_ratio')} FROM (SELECT 'focus_year' AS comparison, count(*) AS m, count(*) FILTER (bad) AS k, NULL AS b FROM screened WHERE year_filing_for = 1996 UNION ALL SELECT 'flagged_in_' || year_filing_for, count(*) FILTER (f), count(*) FILTER (f AND bad), avg(CASE WHEN bad THEN 1.0 ELSE 0.0 END) FROM (SELECT *, establishment_id IN (SELECT establishment_id FROM screened WHERE year_filing_for = 1996 AND bad) AS f FROM screened WHERE year_filing_for IN (1995, 1997)) GROUP BY year_filing_for)")
def focus_year_enrichment(spark, sf_dir):
    return panel.enrichment(panel.flag_panel(base(spark, sf_dir)), 1996)


KIT = CELLS + ", " + YEARS + ", " + LONG + f", zz AS (SELECT *, h0 / sum(h0) OVER (PARTITION BY y0, y1) AS w0, h1 / sum(h1) OVER (PARTITION BY y0, y1) AS w1, {AVG_RANK('r0', 'y0, y1')} AS k0, {AVG_RANK('r1', 'y0, y1')} AS k1 FROM both_), whole AS (SELECT year_filing_for AS y, 200000.0 * sum(c) / sum(h) AS f FROM cells GROUP BY 1)"


@query(f"SELECT {n('z.y0', 'year_from')}, {n('z.y1', 'year_to')}, {n('count(*)', 'n_cells_matched')}, {r('sum(w1 * r1) - sum(w0 * r0)', 'matched_change')}, {r('sum((w0 + w1) / 2 * (r1 - r0))', 'within_effect')}, {r('sum((r0 + r1) / 2 * (w1 - w0))', 'composition_effect')}, {r('any_value(b.f) - any_value(a.f) - (sum(w1 * r1) - sum(w0 * r0))', 'support_residual')}, {n('count(*) FILTER (r1 < r0)', 'declining_cells')}, {r('CASE WHEN count(*) > 1 AND var_pop(k0) > 0 AND var_pop(k1) > 0 THEN covar_pop(k0, k1) / (stddev_pop(k0) * stddev_pop(k1)) END', 'rank_spearman')} FROM zz z JOIN whole a ON a.y = z.y0 JOIN whole b ON b.y = z.y1 GROUP BY z.y0, z.y1", KIT)
def kitagawa_decomposition(spark, sf_dir):
    return influence.kitagawa(table(spark, sf_dir, cuts=False))


LOCO = CELLS + ", " + YEARS + ", sides AS (SELECT y0, y1, naics3, band, sum(h0) AS h0, sum(c0) AS c0, sum(h1) AS h1, sum(c1) AS c1 FROM (SELECT y0, y1, naics3, band, h AS h0, c AS c0, 0 AS h1, 0 AS c1 FROM pairs JOIN cells ON year_filing_for = y0 UNION ALL SELECT y0, y1, naics3, band, 0, 0, h, c FROM pairs JOIN cells ON year_filing_for = y1) GROUP BY ALL), lo_ AS (SELECT *, 200000.0 * (sum(c0) OVER w - c0) / nullif(sum(h0) OVER w - h0, 0) AS b, 200000.0 * (sum(c1) OVER w - c1) / nullif(sum(h1) OVER w - h1, 0) AS a, 200000.0 * sum(c1) OVER w / sum(h1) OVER w - 200000.0 * sum(c0) OVER w / sum(h0) OVER w AS o FROM sides WINDOW w AS (PARTITION BY y0, y1))"


@query(f"SELECT {n('y0', 'year_from')}, {n('y1', 'year_to')}, naics3, band AS size_band, {r('b', 'rate_before')}, {r('a', 'rate_after')}, {r('a - b', 'change_without')}, {r('o', 'change_original')}, (a - b) * o < 0 AS reversed FROM lo_", LOCO)
def leave_one_cell_out(spark, sf_dir):
    return influence.leave_one_cell_out(table(spark, sf_dir, cuts=False))


LOO = "loo AS (SELECT id, establishment_id, year_filing_for AS year, hours, cases, sum(hours) OVER w AS h, sum(cases) OVER w AS c, hours / sum(hours) OVER w AS hs, cases / nullif(sum(cases) OVER w, 0) AS cs, 200000.0 * sum(cases) OVER w / sum(hours) OVER w AS rate, CASE WHEN sum(hours) OVER w - hours > 0 THEN 200000.0 * (sum(cases) OVER w - cases) / (sum(hours) OVER w - hours) END AS wo FROM screened WHERE NOT bad WINDOW w AS (PARTITION BY year_filing_for))"


@query(f"SELECT id, establishment_id, {n('year', 'year')}, {r('hours', 'hours')}, {r('cases', 'cases')}, {r('hs', 'hours_share')}, {r('cs', 'cases_share')}, {r('rate', 'rate')}, {r('wo', 'rate_without')}, {r('wo - rate', 'change')} FROM loo", LOO)
def leave_one_filing_out(spark, sf_dir):
    return influence.leave_one_filing_out(base(spark, sf_dir))


@query(f"SELECT id, {n('year', 'year')}, {n('rank', 'rank')}, {r('hours', 'hours')} FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY round(abs(wo - rate), 12) DESC, id) AS rank FROM loo) WHERE rank <= 10", LOO)
def influence_ranking(spark, sf_dir):
    loo = influence.leave_one_filing_out(base(spark, sf_dir)).withColumn("change", F.round("change", 12))
    return influence.influence_ranking(loo).select("id", "year", "rank", "hours")


@query(f"SELECT {n('year', 'year')}, {n('count(*)', 'n_filings')}, {r('sum(hs * hs)', 'hours_hhi')}, {r('1 / sum(hs * hs)', 'equivalent_filings')}, {r('max(hs)', 'top_hours_share')}, {r('max(abs(wo - rate))', 'max_abs_change')}, {r('max(wo - rate)', 'largest_rise')}, {r('min(wo - rate)', 'largest_fall')} FROM loo GROUP BY year", LOO)
def exposure_hhi(spark, sf_dir):
    return influence.exposure_concentration(influence.leave_one_filing_out(base(spark, sf_dir)))


@query(f"SELECT {n('y0', 'year_before')}, {n('y1', 'year_after')}, {n('year', 'removal_year')}, id, {r('hours', 'hours')}, {r('cases', 'cases')}, {r('100 * (r1 / r0 - 1)', 'original_change_pct')}, {r('100 * (n1 / n0 - 1)', 'review_change_pct')} FROM (SELECT y0, y1, year, id, hours, cases, a.rate AS r0, b.rate AS r1, CASE WHEN year = y0 THEN wo ELSE a.rate END AS n0, CASE WHEN year = y1 THEN wo ELSE b.rate END AS n1 FROM pairs JOIN loo ON year = y0 OR year = y1 JOIN (SELECT year AS ya, max(rate) AS rate FROM loo GROUP BY year) a ON ya = y0 JOIN (SELECT year AS yb, max(rate) AS rate FROM loo GROUP BY year) b ON yb = y1) WHERE (n1 - n0) * (r1 - r0) < 0", f"{LOO}, {YEARS}")
def trend_reversals(spark, sf_dir):
    return influence.trend_reversals(base(spark, sf_dir))


GOOD = "g AS (SELECT year_filing_for AS year, id, hours AS h, cases AS c, emp AS e, row_number() OVER (PARTITION BY year_filing_for ORDER BY hours DESC, id) AS rk FROM screened WHERE NOT bad), w AS (SELECT year, sum(h) AS th, sum(c) AS tc FROM g GROUP BY year)"
SCEN = GOOD + ", s AS (" + " UNION ALL ".join(["SELECT year, 'baseline' AS scenario, 0 AS rh, 0 AS rc FROM w"] + [f"SELECT year, 'without_top_{k}', sum(h) FILTER (rk <= {k}), sum(c) FILTER (rk <= {k}) FROM g GROUP BY year" for k in (1, 2, 10)] + [f"SELECT year, 'without_above_{e}', coalesce(sum(h) FILTER (e > {e}), 0), coalesce(sum(c) FILTER (e > {e}), 0) FROM g GROUP BY year" for e in (100, 200)]) + ")"


@query(f"SELECT {n('s.year', 'year')}, scenario, {r('200000.0 * (tc - rc) / nullif(th - rh, 0)', 'rate')}, {r('rh', 'removed_hours')}, {r('rc', 'removed_cases')} FROM s JOIN w ON s.year = w.year", SCEN)
def exclusion_scenarios(spark, sf_dir):
    return influence.exclusion_scenarios(base(spark, sf_dir))


@query(f"""SELECT {n('s.year', 'year')}, scenario, {r('rc', 'removed_cases')}, {r('rh', 'removed_hours')}, {r('b0', 'baseline_rate')}, {r('b1', 'cases_only_rate')}, {r('b2', 'hours_only_rate')}, {r('b3', 'joint_rate')}, {r('b3 - b0', 'joint_change')}, {r('((b1 - b0) + (b3 - b2)) / 2', 'numerator_effect')}, {r('((b2 - b0) + (b3 - b1)) / 2', 'denominator_effect')}
  FROM (SELECT s.*, 200000.0 * tc / th AS b0, 200000.0 * (tc - rc) / th AS b1, 200000.0 * tc / (th - rh) AS b2, 200000.0 * (tc - rc) / (th - rh) AS b3 FROM s JOIN w ON s.year = w.year WHERE scenario IN ('without_top_1', 'without_top_2')) s""", SCEN)
def deletion_accounting(spark, sf_dir):
    return influence.deletion_accounting(base(spark, sf_dir))


WIL = "wl AS (SELECT naics3, CAST(count(*) AS DOUBLE) AS m, CAST(count(*) FILTER (bad) AS DOUBLE) AS k FROM screened WHERE naics3 IS NOT NULL GROUP BY naics3), wi AS (SELECT *, k / m AS p, 1.959963984540054 AS z FROM wl), wx AS (SELECT *, greatest(0, (p + z*z/(2*m)) / (1 + z*z/m) - z * sqrt(p*(1-p)/m + z*z/(4*m*m)) / (1 + z*z/m)) AS lo, least(1, (p + z*z/(2*m)) / (1 + z*z/m) + z * sqrt(p*(1-p)/m + z*z/(4*m*m)) / (1 + z*z/m)) AS hi FROM wi), po AS (SELECT avg(CASE WHEN bad THEN 1.0 ELSE 0.0 END) AS pooled FROM screened)"


@query(f"SELECT naics3, {n('m', 'n')}, {n('k', 'k')}, {r('p', 'share')}, {r('lo', 'low')}, {r('hi', 'high')}, CASE WHEN lo > pooled THEN 'above' WHEN hi < pooled THEN 'below' ELSE 'overlaps' END AS vs_pooled FROM wx, po", WIL)
def wilson_by_sector(spark, sf_dir):
    return sectors.wilson_by(base(spark, sf_dir), "naics3")


@query(f"SELECT {r('sum((k - n * p) * (k - n * p) / (n * p) + (k - n * p) * (k - n * p) / (n * (1 - p)))', 'chi2')}, {n('count(*) - 1', 'df')} FROM yt, (SELECT k / n AS p FROM tt)", TOTALS)
def chi2_years(spark, sf_dir):
    return stats.chi2_homogeneity(sectors.flag_counts(base(spark, sf_dir), "year_filing_for"), "k", "n")


@query(f"SELECT naics3, {n('coalesce(tk, 0)', 'top_n')}, {r('coalesce(th, 0) / h', 'top_hours_share')}, {r('200000.0 * c / h', 'trir_unscreened')}, {r('200000.0 * (c - coalesce(tc, 0)) / (h - coalesce(th, 0))', 'trir_unscreened_ex_top')}, {r('(200000.0 * gc / gh) / nullif(200000.0 * (c - coalesce(tc, 0)) / (h - coalesce(th, 0)), 0)', 'ratio_ex_top')} FROM (SELECT naics3, sum(hours) AS h, sum(cases) AS c, sum(hours) FILTER (NOT bad) AS gh, sum(cases) FILTER (NOT bad) AS gc FROM screened WHERE naics3 IS NOT NULL GROUP BY naics3) LEFT JOIN (SELECT naics3, count(*) AS tk, sum(hours) AS th, coalesce(sum(cases), 0) AS tc FROM (SELECT * FROM screened WHERE f_high ORDER BY hours DESC, id LIMIT 50) GROUP BY naics3) USING (naics3)")
def sector_ex_top50(spark, sf_dir):
    return sectors.without_top(base(spark, sf_dir), "naics3")


@query(f"SELECT {r('1 - sum((x - x0) * (y + y0))', 'gini')} FROM (SELECT x, y, coalesce(lag(x) OVER (ORDER BY x, y), 0) AS x0, coalesce(lag(y) OVER (ORDER BY x, y), 0) AS y0 FROM (SELECT sum(m) OVER o / sum(m) OVER () AS x, sum(k) OVER o / sum(k) OVER () AS y FROM wl WINDOW o AS (ORDER BY k / m, naics3 ROWS UNBOUNDED PRECEDING)))", WIL)
def lorenz_gini(spark, sf_dir):
    return stats.gini(stats.lorenz(sectors.flag_counts(base(spark, sf_dir), "naics3"), "k", "n", "naics3"))


@query(f"SELECT naics3, state FROM (SELECT naics3, state, row_number() OVER (PARTITION BY naics3 ORDER BY count(*) DESC, state) AS p FROM screened WHERE state IS NOT NULL GROUP BY naics3, state) WHERE p = 1")
def modal_state(spark, sf_dir):
    return sectors.modal(base(spark, sf_dir), "naics3", "state")


SERIES = "sr AS (SELECT naics3, year_filing_for AS year, 200000.0 * sum(cases) / sum(hours) AS v FROM screened WHERE NOT bad GROUP BY 1, 2), ro AS (SELECT *, CASE WHEN count(v) OVER w = 3 THEN v - avg(v) OVER w END AS miss, row_number() OVER (PARTITION BY naics3 ORDER BY year DESC) AS place FROM sr WINDOW w AS (PARTITION BY naics3 ORDER BY year ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))"


@query(f"SELECT naics3, {n('max(year)', 'last_time')}, {r('avg(v) FILTER (place <= 3)', 'forecast')}, {r('avg(v) FILTER (place <= 3) - 2.4469 * sqrt(avg(miss * miss))', 'low')}, {r('avg(v) FILTER (place <= 3) + 2.4469 * sqrt(avg(miss * miss))', 'high')}, {n('count(miss)', 'n_tested')} FROM ro GROUP BY naics3", SERIES)
def rolling_forecast(spark, sf_dir):
    good = base(spark, sf_dir).filter(~F.col("implausible")).groupBy("naics3", F.col("year_filing_for").alias("year")).agg(rates.pooled_rate(F.sum("recordable_cases"), F.sum("total_hours_worked")).alias("v"))
    return stability.rolling_forecast(good, "naics3", "year", "v")


@query(f"SELECT naics3, {n('count(*)', 'n')}, {r('sum(cases) / (sum(hours) / 200000.0)', 'mu')} FROM screened WHERE NOT bad AND cases >= 0 AND hours > 0 AND naics3 IS NOT NULL GROUP BY naics3 HAVING count(*) >= 200")
def poisson_rates(spark, sf_dir):
    good = base(spark, sf_dir).filter(~F.col("implausible") & (F.col("recordable_cases") >= 0) & (F.col("total_hours_worked") > 0) & F.col("naics3").isNotNull())
    return good.groupBy("naics3").agg(F.count("*").alias("n"), (F.sum("recordable_cases") / (F.sum("total_hours_worked") / 200_000.0)).alias("mu")).filter("n >= 200")


#: What SQL knows of the fits: it looks for each optimum itself, on grids of 5 points in each direction around the best so far, each 0.6 times as
#: wide as the one before. m, a, p: log of the mean of all (extra zeros included), log dispersion, logit of the extra zeros; so told, they hardly
#: depend on each other.
FIT_DATA = """
sel AS (SELECT naics3 FROM screened WHERE NOT bad AND naics3 IS NOT NULL GROUP BY naics3 HAVING count(*) >= 200 ORDER BY count(*) DESC, naics3 LIMIT 30),
dat AS (SELECT naics3, cases AS y, avg(e) AS e, CAST(count(*) AS DOUBLE) AS w FROM (SELECT naics3, cases, hours / 200000.0 AS e FROM screened WHERE NOT bad AND cases >= 0 AND hours > 0 AND naics3 IN (SELECT naics3 FROM sel)) GROUP BY naics3, cases, floor(ln(e) * 1000)),
fit0 AS (SELECT naics3, sum(w) AS n, ln(sum(w * y) / sum(w * e)) AS m FROM dat GROUP BY naics3)"""
LOG_POISSON = "(y * (m + ln(e)) - exp(m) * e - lgamma(y + 1))"
LOG_NB2 = "(lgamma(y + exp(-a)) - lgamma(exp(-a)) - lgamma(y + 1) - (y + exp(-a)) * ln(1 + exp(a + m) * e) + y * (a + m + ln(e)))"
WITH_ZEROS = lambda base: f"(CASE WHEN y = 0 THEN ln(1 / (1 + exp(-p)) + exp({base}) / (1 + exp(p))) ELSE {base} - ln(1 + exp(p)) END)"
OF_THE_REST = lambda base: base.replace("m +", "m + ln(1 + exp(p)) +").replace("a + m)", "a + m + ln(1 + exp(p)))").replace("exp(m)", "exp(m) * (1 + exp(p))")
LOG_LAWS = {"poisson": LOG_POISSON, "nb2": LOG_NB2, "zip": WITH_ZEROS(OF_THE_REST(LOG_POISSON)), "zinb": WITH_ZEROS(OF_THE_REST(LOG_NB2))}


def searched(model: str, levels: int = 26, width: float = 4.0, shrink: float = 0.6) -> str:
    """CTEs that end with <model>_best (naics3, n, ll): the greatest log likelihood of each industry, and which parameters were free."""
    free = {"poisson": "", "nb2": "a", "zip": "p", "zinb": "ap"}[model]
    out = [f"{model}_0 AS (SELECT naics3, n, m, CAST(0 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS p, CAST(0 AS DOUBLE) AS ll FROM fit0)"]
    moved = lambda c, on, step: f"{c} + d{c} * {step} AS {c}" if on else c
    steps = lambda c, on: f", (VALUES (-2), (-1), (0), (1), (2)) v{c}(d{c})" if on else ""
    for i in range(1, levels + 1 if free else 2):
        step = width * shrink ** (i - 1)
        at = f"SELECT naics3, n, {moved('m', bool(free), step)}, {moved('a', 'a' in free, step)}, {moved('p', 'p' in free, step)} FROM {model}_{i - 1}{steps('m', bool(free))}{steps('a', 'a' in free)}{steps('p', 'p' in free)}"
        out.append(f"{model}_{i} AS (SELECT naics3, n, x.m AS m, x.a AS a, x.p AS p, x.ll AS ll FROM (SELECT naics3, n, max_by({{'m': m, 'a': a, 'p': p, 'll': ll}}, ll) AS x FROM (SELECT naics3, n, m, a, p, sum(w * {LOG_LAWS[model]}) AS ll FROM ({at}) JOIN dat USING (naics3) GROUP BY ALL) GROUP BY naics3, n))")
    return ", ".join([*out, f"{model}_best AS (SELECT naics3, n, ll, {1 + len(free)} AS k, m, a, p FROM {model}_{levels if free else 1})"])


def fits(model: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Each industry's greatest likelihood, and whether no point of a ring around the fit has a greater one."""
        out = counts.fit_industries(base(spark, sf_dir), (model,))
        return out.select("naics3", "model", "n", "k", F.round("loglik", 1).alias("loglik"), F.round("aic", 1).alias("aic"), (F.col("ring_gain") < 1e-4).alias("no_better_near"))

    run.__name__ = f"{model}_fit"
    return run


for _model in counts.MODELS:
    query(f"SELECT naics3, '{_model}' AS model, n, CAST(k AS BIGINT) AS k, round(ll, 1) AS loglik, round(2 * k - 2 * ll, 1) AS aic, true AS no_better_near FROM {_model}_best", f"{FIT_DATA}, {searched(_model)}")(fits(_model))


EACH_FILING = FIT_DATA.replace("floor(ln(e) * 1000)", "e")


@query(" UNION ALL ".join(f"SELECT naics3, '{m}' AS model, CAST(n AS BIGINT) AS n, CAST(k AS BIGINT) AS k, round(ll, 1) AS loglik, true AS near_the_binned FROM {m}_best" for m in counts.MODELS), ", ".join([EACH_FILING, *map(searched, counts.MODELS)]))
def exact_fits(spark, sf_dir):
    """Fits over every filing by itself; those over binned exposure lie within a tenth of their log likelihood."""
    out = exact_models.exact_fits(base(spark, sf_dir))
    return out.select("naics3", "model", "n", "k", F.round("loglik", 1).alias("loglik"), (F.abs("gap") < 0.1).alias("near_the_binned"))


BAND_DATA = """
sel AS (SELECT naics3 FROM screened WHERE NOT bad AND naics3 IS NOT NULL GROUP BY naics3 HAVING count(*) >= 200 ORDER BY count(*) DESC, naics3 LIMIT 30),
dat AS (SELECT naics3, band, cases AS y, avg(e) AS e, CAST(count(*) AS DOUBLE) AS w FROM (SELECT naics3, band, cases, hours / 200000.0 AS e FROM keyed WHERE NOT bad AND cases >= 0 AND hours > 0 AND band IS NOT NULL AND naics3 IN (SELECT naics3 FROM sel)) GROUP BY naics3, band, cases, floor(ln(e) * 1000)),
fit0 AS (SELECT naics3, band, sum(w) AS n, ln(greatest(sum(w * y), 1e-9) / sum(w * e)) AS m FROM dat GROUP BY naics3, band)"""


def searched_by_band(model: str, levels: int = 26, width: float = 4.0, shrink: float = 0.6) -> str:
    """As searched(), with a mean for each band: for a given dispersion and share of zeros the bands' means are found one by one."""
    free = {"poisson": "", "nb2": "a", "zip": "p", "zinb": "ap"}[model]
    out = [f"{model}_0 AS (SELECT naics3, band, n, m, CAST(0 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS p, CAST(0 AS DOUBLE) AS ll FROM fit0)"]
    moved = lambda c, on, step: f"{c} + d{c} * {step} AS {c}" if on else c
    steps = lambda c, on: f", (VALUES (-2), (-1), (0), (1), (2)) v{c}(d{c})" if on else ""
    last = levels if free else 1
    for i in range(1, last + 1):
        step = width * shrink ** (i - 1)
        at = f"SELECT naics3, band, n, {moved('m', bool(free), step)}, {moved('a', 'a' in free, step)}, {moved('p', 'p' in free, step)} FROM {model}_{i - 1}{steps('m', bool(free))}{steps('a', 'a' in free)}{steps('p', 'p' in free)}"
        out.append(f"{model}_b{i} AS MATERIALIZED (SELECT naics3, band, n, a, p, max_by(m, ll) AS m, max(ll) AS ll FROM (SELECT naics3, band, n, m, a, p, sum(w * {LOG_LAWS[model]}) AS ll FROM ({at}) JOIN dat USING (naics3, band) GROUP BY ALL) GROUP BY naics3, band, n, a, p)")
        out.append(f"{model}_{i} AS (SELECT b.* FROM {model}_b{i} b JOIN (SELECT naics3, max_by({{'a': a, 'p': p}}, ll) AS x FROM (SELECT naics3, a, p, sum(ll) AS ll FROM {model}_b{i} GROUP BY ALL) GROUP BY naics3) t ON t.naics3 = b.naics3 AND t.x.a = b.a AND t.x.p = b.p)")
    return ", ".join([*out, f"{model}_best AS (SELECT naics3, sum(n) AS n, count(*) + {len(free)} AS k, sum(ll) AS ll FROM {model}_{last} GROUP BY naics3)"])


@query(" UNION ALL ".join(f"SELECT naics3, '{m}' AS model, n, CAST(k AS BIGINT) AS k, round(ll, 1) AS loglik, round(2 * k - 2 * ll, 1) AS aic FROM {m}_best" for m in counts.MODELS), ", ".join([BAND_DATA, *map(searched_by_band, counts.MODELS)]))
def covariate_fits(spark, sf_dir):
    """Fits with a mean for each size band; SQL finds the same greatest likelihoods by grids."""
    return counts.fit_covariates(base(spark, sf_dir)).select("naics3", "model", "n", "k", F.round("loglik", 1).alias("loglik"), F.round("aic", 1).alias("aic"))


@query()
def fixed_effect_fits(spark, sf_dir):
    return counts.fit_covariates(base(spark, sf_dir), fixed="state").select("naics3", "model", "n", "k", F.round("loglik", 3).alias("loglik"), F.round("aic", 3).alias("aic"), "converged")


@query(f"SELECT model, {n('count(*) FILTER (place = 1)', 'wins')}, {n('count(*)', 'fits')} FROM (SELECT model, row_number() OVER (PARTITION BY naics3 ORDER BY round(2 * k - 2 * ll, 6), model) AS place FROM (" + " UNION ALL ".join(f"SELECT '{m}' AS model, * FROM {m}_best" for m in counts.MODELS) + ")) GROUP BY model", ", ".join([FIT_DATA, *map(searched, counts.MODELS)]))
def aic_selection(spark, sf_dir):
    return counts.selection(counts.fit_industries(base(spark, sf_dir)))


DEALT = f"""{YEARS},
fp AS (SELECT establishment_id AS e, year_filing_for AS y, CAST(bad AS INTEGER) AS f FROM screened WHERE establishment_id IS NOT NULL AND year_filing_for IS NOT NULL),
sz AS (SELECT y, sum(f) AS k FROM fp GROUP BY y),
dl AS (SELECT rep, e, y, row_number() OVER (PARTITION BY rep, y ORDER BY u, e) <= k AS x FROM (SELECT *, CAST(('0x' || substr(md5('20260909|' || e || '|' || y || '|' || rep), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u FROM fp, range(0, 200) t(rep)) JOIN sz USING (y)),
ce AS (SELECT a.rep, count(*) FILTER (a.x AND b.x) AS n11, count(*) FILTER (a.x AND NOT b.x) AS n10, count(*) FILTER (NOT a.x AND b.x) AS n01, count(*) FILTER (NOT a.x AND NOT b.x) AS n00 FROM pairs JOIN dl a ON a.y = y0 JOIN dl b ON b.y = y1 AND a.e = b.e AND a.rep = b.rep GROUP BY a.rep)"""


@query(f"SELECT {n('rep', 'rep')}, {r('n11 * n00 / nullif(n10 * n01, 0)', 'odds_ratio')} FROM ce", DEALT)
def permutation_null(spark, sf_dir):
    return panel.permutation_null(panel.flag_panel(base(spark, sf_dir)))


P, OT = graph.Property, graph.ObjectType
SPEC = graph.Spec(
    {
        "Filing": OT("Filing", "filing_id", {"filing_id": P("integer", False), "establishment_id": P("integer"), "year": P("integer"), "naics3": P("string"), "peer_group": P("string"), "hours": P("double"), "cases": P("double"), "implausible": P("boolean", False), **{f: P("boolean", False) for f in screen.FLAGS}, "analyst_flag": P("boolean", False, True, False), "benchmark_excluded": P("boolean", False, True, False), "note": P("string", True, True)}),
        "Establishment": OT("Establishment", "establishment_id", {"establishment_id": P("integer", False), "company_name": P("string"), "state": P("string")}),
        "ReportingYear": OT("ReportingYear", "year", {"year": P("integer", False), "n_filings": P("integer"), "implausible_share": P("double"), "trir": P("double"), "dart": P("double"), "severity": P("double")}),
        "Industry": OT("Industry", "naics3", {"naics3": P("string", False), "title": P("string"), "naics2": P("string")}), "Sector": OT("Sector", "naics2", {"naics2": P("string", False), "title": P("string")}),
        "PeerGroup": OT("PeerGroup", "peer_group", {"peer_group": P("string", False), "naics3": P("string"), "n": P("integer")}), "QualityFlag": OT("QualityFlag", "flag", {"flag": P("string", False)}),
    },
    {x.name: x for x in (graph.Link("filed_by", "Filing", "Establishment", "establishment_id", "filings"), graph.Link("in_year", "Filing", "ReportingYear", "year", "filings_of_year"), graph.Link("in_industry", "Filing", "Industry", "naics3", "filings_of_industry"), graph.Link("in_group", "Filing", "PeerGroup", "peer_group", "filings_of_group"), graph.Link("group_industry", "PeerGroup", "Industry", "naics3", "groups"), graph.Link("in_sector", "Industry", "Sector", "naics2", "industries"), graph.Link("raises", "Filing", "QualityFlag", None, "raised_by"))},
    {
        "flag_filing": graph.Action("flag_filing", "Filing", {"reason": graph.Parameter("string", True, None, None, 500)}, {"analyst_flag": True, "note": "$reason"}, {"analyst_flag": False}),
        "clear_flag": graph.Action("clear_flag", "Filing", {"reason": graph.Parameter("string", True)}, {"analyst_flag": False, "note": "$reason"}, {"analyst_flag": True}),
        "exclude": graph.Action("exclude", "Filing", {"kind": graph.Parameter("string", True, None, ("unit_error", "duplicate", "other")), "detail": graph.Parameter("string", False, ("kind", "other"), None, 500)}, {"benchmark_excluded": True, "note": "$detail"}, {"benchmark_excluded": False}),
        "include_again": graph.Action("include_again", "Filing", {"reason": graph.Parameter("string", True, None, None, 500)}, {"benchmark_excluded": False, "note": "$reason"}, {"benchmark_excluded": True}),
    },
)


def store(spark: SparkSession, sf_dir: str, check: bool = False) -> graph.Store:
    """The object graph of the filings view."""
    rows = with_peer_keys(base(spark, sf_dir))
    s = graph.Store(spark, SPEC)
    s.add("Filing", rows.select(F.col("id").alias("filing_id"), "establishment_id", F.col("year_filing_for").alias("year"), "naics3", "peer_group", F.col("total_hours_worked").alias("hours"), F.col("recordable_cases").alias("cases"), "implausible", *screen.FLAGS), check)
    s.add("Establishment", graph.latest_by(rows, "establishment_id", "year_filing_for", "id"), check)
    quality = rows.groupBy(F.col("year_filing_for").alias("year")).agg(F.count("*").alias("n_filings"), F.avg(F.col("implausible").cast("double")).alias("implausible_share"))
    metrics = rates.rates(rows, "year_filing_for").select(F.col("year_filing_for").alias("year"), *(F.col(f"{c}_screened").alias(c) for c in ("trir", "dart", "severity")))
    s.add("ReportingYear", one_to_one(quality, metrics, ["year"]) if check else quality.join(metrics, "year", "left"), check)
    industries = rows.filter("naics3 is not null").select("naics3", "naics2").distinct()
    s.add("Industry", industries.withColumn("title", naics.title_column(F.col("naics3"))), check)
    s.add("Sector", industries.select("naics2").distinct().withColumn("title", naics.title_column(F.col("naics2"), naics.SECTORS)), check)
    s.add("PeerGroup", rows.filter(~F.col("implausible") & F.col("peer_group").isNotNull()).groupBy("peer_group").agg(F.first("naics3").alias("naics3"), F.count("*").alias("n")), check)
    s.add("QualityFlag", spark.createDataFrame([(f,) for f in screen.FLAGS], "flag string"), check)
    return s


KEYGROUPS = "pg AS (SELECT naics3 || '|' || band AS g FROM keyed WHERE NOT bad AND band IS NOT NULL GROUP BY 1), kg AS (SELECT *, naics3 || '|' || band AS grp FROM keyed)"


#: One end of a foreign key: resolved, null and dangling keys, all counted.
END = lambda link, key, known, rows="kg": f"SELECT '{link}' AS link, {n(f'count(*) FILTER ({key} IN ({known}))', 'resolved')}, {n(f'count(*) FILTER ({key} IS NULL)', 'null_keys')}, {n(f'count(*) FILTER ({key} IS NOT NULL AND {key} NOT IN ({known}))', 'dangling')} FROM {rows}"


@query(
    " UNION ALL ".join([
        END("filed_by", "establishment_id", "SELECT establishment_id FROM screened WHERE establishment_id % 10 <> 3"), END("in_year", "year_filing_for", "SELECT year_filing_for FROM screened WHERE year_filing_for <> 1995"),
        END("in_industry", "naics3", "SELECT naics3 FROM screened WHERE naics3 IS NOT NULL"), END("in_group", "grp", "SELECT g FROM pg"), END("group_industry", "split_part(g, '|', 1)", "SELECT naics3 FROM screened WHERE naics3 IS NOT NULL", "pg"),
        END("in_sector", "naics2", "SELECT naics2 FROM screened", "(SELECT DISTINCT naics3, naics2 FROM screened WHERE naics3 IS NOT NULL)"),
    ]),
    KEYGROUPS,
)
def link_integrity(spark, sf_dir):
    """Over a store that lost a tenth of its establishments and a year, so that keys dangle."""
    s = store(spark, sf_dir)
    s.base["Establishment"] = s.base["Establishment"].filter(F.col("establishment_id") % 10 != 3)
    s.base["ReportingYear"] = s.base["ReportingYear"].filter(F.col("year") != 1995)
    return s.link_integrity()


@query("SELECT DISTINCT establishment_id, CAST(NULL AS VARCHAR) AS nothing FROM screened WHERE f_high OR f_low")
def search_around(spark, sf_dir):
    flags = store(spark, sf_dir).objects("QualityFlag").filter(F.col("flag").contains("hours_per_employee"))
    return flags.search_around("raised_by").search_around("filed_by").keys().select("establishment_id", F.lit(None).cast("string").alias("nothing"))


FIRST = "fe AS (SELECT id FROM screened WHERE NOT bad ORDER BY hours DESC, id LIMIT 2)"


@query(f"SELECT {n('year_filing_for', 'year')}, {n('count(*)', 'n')}, {r('200000.0 * sum(cases) / sum(hours)', 'trir')} FROM screened WHERE NOT bad AND id NOT IN (SELECT id FROM fe) GROUP BY year_filing_for", FIRST)
def action_writeback_rates(spark, sf_dir):
    s = store(spark, sf_dir)
    first, second = (x[0] for x in s.base["Filing"].filter("not implausible").orderBy(F.col("hours").desc(), "filing_id").limit(2).collect())
    s.apply("flag_filing", first, {"reason": "looks like a unit error"}, "analyst")
    s.apply("exclude", second, {"kind": "unit_error"}, "analyst")
    rows = graph.included(s.current("Filing"))
    return rows.groupBy("year").agg(F.count("*").alias("n"), rates.pooled_rate(F.sum("cases"), F.sum("hours")).alias("trir"))


SECOND = "fe AS (SELECT id FROM (SELECT id, row_number() OVER (ORDER BY hours DESC, id) AS p FROM screened WHERE NOT bad) WHERE p = 2)"


@query(f"SELECT {n('year_filing_for', 'year')}, {n('count(*)', 'n')}, {r('200000.0 * sum(cases) / sum(hours)', 'trir')}, {n('6', 'edited_values')} FROM screened WHERE NOT bad AND id NOT IN (SELECT id FROM fe) GROUP BY year_filing_for", SECOND)
def action_reinclusion_rates(spark, sf_dir):
    """Two filings are excluded, and one of them is taken in again: the benchmark lacks only the other."""
    s = store(spark, sf_dir)
    first, second = (x[0] for x in s.base["Filing"].filter("not implausible").orderBy(F.col("hours").desc(), "filing_id").limit(2).collect())
    for key in (first, second):
        s.apply("exclude", key, {"kind": "unit_error"}, "analyst")
    s.apply("include_again", first, {"reason": "confirmed by the filer"}, "reviewer")
    rows = graph.included(s.current("Filing")).filter(~F.col("benchmark_excluded"))
    edits = sum(s.edit_history("Filing", key).count() for key in (first, second))
    return rows.groupBy("year").agg(F.count("*").alias("n"), rates.pooled_rate(F.sum("cases"), F.sum("hours")).alias("trir")).withColumn("edited_values", F.lit(edits))


#: Verdicts counted from the data: some pass, some don't.
VERDICTS = {
    "year.columns": "true", "year.monotone_share": "(SELECT bool_and(nb <= ny) FROM y)", "year.rows": "(SELECT count(*) BETWEEN 1 AND 50 FROM y)", "year.few": "(SELECT count(*) BETWEEN 1 AND 2 FROM y)",
    "year.sum": "(SELECT sum(ny) FROM y) = (SELECT count(*) FROM screened)", "year.sum_bad": "(SELECT sum(nb) FROM y) = (SELECT count(*) FROM screened)", "year.unique": "true",
    "year.share": "(SELECT bool_and(1.0 * nb / ny <= 0.02) FROM y)", "cells.monotone": "true", "cells.range": "(SELECT bool_and(z BETWEEN 0 AND 1) FROM zs)", "cells.zero": "(SELECT bool_and(z <= 0.5) FROM zs)",
    "cells.lookup": "true", "rows.id": "(SELECT count(*) = count(DISTINCT id) FROM screened)", "rows.establishment": "(SELECT count(*) = count(DISTINCT establishment_id) FROM screened)",
    "rows.hours": "(SELECT bool_and(coalesce(hours > 0, false)) FROM screened)", "rows.states": "(SELECT count(*) FILTER (state NOT LIKE 'S%') = 0 FROM screened)",
}
YEARS_AND_CELLS = "y AS (SELECT year_filing_for, count(*) AS ny, count(*) FILTER (bad) AS nb FROM screened GROUP BY 1), zs AS (SELECT avg(CASE WHEN trir = 0 THEN 1.0 ELSE 0.0 END) AS z FROM keyed WHERE NOT bad AND trir IS NOT NULL AND band IS NOT NULL GROUP BY year_filing_for, naics3, band)"


@query(" UNION ALL ".join([*(f"SELECT '{k}' AS id, CASE WHEN {v} THEN 'pass' ELSE 'fail' END AS status" for k, v in VERDICTS.items()), "SELECT 'missing.skip', 'skip'"]), YEARS_AND_CELLS)
def expectations(spark, sf_dir):
    rows = base(spark, sf_dir)
    tables = {"year": rates.summarise(rows, "year_filing_for"), "cells": peers.percentile_table(rows), "all": rates.summarise(rows), "rows": rows.withColumn("initial", F.substring("state", 1, 1))}
    E = ex.Expectation
    rules = [
        E("year.columns", "year", "columns", {"columns": ["n_filings", "hours_total"]}), E("year.monotone_share", "year", "col_le", {"left": "n_implausible", "right": "n_filings"}), E("year.rows", "year", "rows", {"low": 1, "high": 50}),
        E("year.sum", "year", "sum_ref", {"column": "n_filings", "other": "all", "other_column": "n_filings"}), E("year.unique", "year", "unique", {"columns": ["year_filing_for"]}), E("cells.monotone", "cells", "monotone_row", {"columns": [*PCT]}),
        E("cells.range", "cells", "range", {"column": "zero_share", "low": 0, "high": 1}), E("cells.lookup", "cells", "lookup", {"columns": ["year_filing_for"], "other": "year", "other_columns": ["year_filing_for"]}), E("missing.skip", "none", "rows", {}, if_missing="skip"),
        E("year.few", "year", "rows", {"low": 1, "high": 2}), E("year.sum_bad", "year", "sum_ref", {"column": "n_implausible", "other": "all", "other_column": "n_filings"}), E("year.share", "year", "range", {"column": "implausible_share", "high": 0.02}),
        E("cells.zero", "cells", "range", {"column": "zero_share", "high": 0.5}), E("rows.id", "rows", "unique", {"columns": ["id"]}), E("rows.establishment", "rows", "unique", {"columns": ["establishment_id"]}),
        E("rows.hours", "rows", "range", {"column": "total_hours_worked", "low": 1e-9}), E("rows.states", "rows", "value_in", {"column": "initial", "values": ["S"]}),
    ]
    return ex.check(spark, tables, rules).select("id", "status")


#: Tails of Poisson and binomial laws in SQL; ends of intervals by halving, as many times as a double has digits.
POISSON_UPTO = lambda k, m: f"list_sum(list_transform(generate_series(0, {k}), lambda j: exp(j * ln({m}) - {m} - lgamma(j + 1))))"
BINOMIAL_UPTO = lambda k, m, p: f"list_sum(list_transform(generate_series(0, {k}), lambda j: exp(lgamma({m} + 1) - lgamma(j + 1) - lgamma({m} - j + 1) + j * ln({p}) + ({m} - j) * ln(1 - {p}))))"
HALVED = lambda name, keys, start, low, high, above: f"{name} AS (SELECT {keys}, 0 AS i, CAST({low} AS DOUBLE) AS a, CAST({high} AS DOUBLE) AS b FROM {start} UNION ALL SELECT {keys}, i + 1, CASE WHEN {above} THEN a ELSE (a + b) / 2 END, CASE WHEN {above} THEN (a + b) / 2 ELSE b END FROM {name} WHERE i < 60)"
SMALL = "small AS (SELECT state, count(*) AS nn, count(*) FILTER (bad) AS kk, sum(hours) FILTER (hours > 0) AS h, CAST(sum(CASE WHEN cases > 0 THEN cases ELSE 0 END) AS BIGINT) % 60 AS c FROM screened GROUP BY state)"


def by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each state: filings, flagged ones, hours and a count of cases below 60."""
    return base(spark, sf_dir).groupBy("state").agg(
        F.count("*").alias("n"), F.count_if("implausible").alias("k"), F.sum(F.when(F.col("total_hours_worked") > 0, F.col("total_hours_worked"))).alias("hours"),
        (F.sum(F.when(F.col("recordable_cases") > 0, F.col("recordable_cases")).otherwise(0.0)).cast("long") % 60).alias("c"),
    )


@query(
    f"SELECT lo.state, {n('lo.c', 'cases')}, {r('CASE WHEN lo.c = 0 THEN 0 ELSE lo.a END', 'low')}, {r('hi.a', 'high')} FROM lo JOIN hi ON lo.state = hi.state WHERE lo.i = 60 AND hi.i = 60",
    f"{SMALL}, " + HALVED("lo", "state, c", "small", "0", "2 * c + 40", f"1 - CASE WHEN c = 0 THEN 0 ELSE {POISSON_UPTO('c - 1', '((a + b) / 2)')} END > 0.025") + ", " + HALVED("hi", "state, c", "small", "0", "2 * c + 40", f"{POISSON_UPTO('c', '((a + b) / 2)')} < 0.025"),
)
def poisson_intervals(spark, sf_dir):
    """Exact intervals of counts, against SQL that solves for their coverage."""
    return by_state(spark, sf_dir).select("state", F.col("c").alias("cases"), exact.poisson_interval(F.col("c")).alias("i")).select("state", "cases", "i.low", "i.high")


@query(
    f"SELECT lo.state, {n('lo.kk', 'k')}, {n('lo.nn', 'n')}, {r('CASE WHEN lo.kk = 0 THEN 0 ELSE lo.a END', 'low')}, {r('CASE WHEN lo.kk = lo.nn THEN 1 ELSE hi.a END', 'high')} FROM lo JOIN hi ON lo.state = hi.state WHERE lo.i = 60 AND hi.i = 60",
    f"{SMALL}, " + HALVED("lo", "state, kk, nn", "small", "0", "1", f"1 - CASE WHEN kk = 0 THEN 0 ELSE {BINOMIAL_UPTO('kk - 1', 'nn', '((a + b) / 2)')} END > 0.025") + ", " + HALVED("hi", "state, kk, nn", "small", "0", "1", f"{BINOMIAL_UPTO('kk', 'nn', '((a + b) / 2)')} < 0.025"),
)
def share_intervals(spark, sf_dir):
    """Exact intervals of flagged shares, against SQL that solves for their coverage."""
    return by_state(spark, sf_dir).select("state", "k", "n", exact.share_interval(F.col("k"), F.col("n")).alias("i")).select("state", "k", "n", "i.low", "i.high")


@query("SELECT CAST(x AS BIGINT) AS x, CAST(df AS BIGINT) AS df, round(exp(-x / 2.0) * list_sum(list_transform(generate_series(0, CAST(df / 2 - 1 AS BIGINT)), lambda j: exp(j * ln(x / 2.0) - lgamma(j + 1)))), 6) AS tail FROM (SELECT DISTINCT 1 + c AS x FROM small), (VALUES (2), (4), (10), (40)) t(df)", SMALL)
def chi_square_tails(spark, sf_dir):
    """Tails of chi-square at even degrees of freedom, which are finite sums."""
    rows = by_state(spark, sf_dir).select((F.col("c") + 1).alias("x")).distinct().withColumn("df", F.explode(F.array(*(F.lit(d).cast("long") for d in (2, 4, 10, 40)))))
    return rows.withColumn("tail", exact.chi_square_tail(F.col("x"), F.col("df")))


BANDS = "bands AS (SELECT band, count(*) AS n, avg(cases) AS mc, 200000.0 * sum(cases) / sum(hours) AS rate FROM keyed WHERE NOT bad AND band IS NOT NULL GROUP BY band HAVING sum(cases) > 0), bd AS (SELECT *, 200000.0 * mc / rate AS mh FROM bands)"
#: The least count of each precision, by the ends of every count's interval up to 150.
PRECISION = "ks AS (SELECT CAST(k AS INTEGER) AS k FROM range(1, 150) t(k)), " + HALVED("plo", "k", "ks", "0", "2 * k + 40", f"1 - {POISSON_UPTO('k - 1', '((a + b) / 2)')} > 0.025") + ", " + HALVED("phi", "k", "ks", "0", "2 * k + 40", f"{POISSON_UPTO('k', '((a + b) / 2)')} < 0.025") + ", need AS (SELECT ratio, min(plo.k) AS cases FROM plo JOIN phi ON plo.k = phi.k, (VALUES (1.5), (2.0), (3.0)) v(ratio) WHERE plo.i = 60 AND phi.i = 60 AND phi.a <= ratio * plo.a GROUP BY ratio)"


@query(f"SELECT band AS size_band, {r('ratio', 'ratio')}, {n('cases', 'cases')}, {r('cases * 200000.0 / rate', 'hours')}, {r('cases * 200000.0 / rate / mh', 'site_years')} FROM bd, need", f"{BANDS}, {PRECISION}")
def precision_cases(spark, sf_dir):
    """Cases, hours and filings that make a band's rate precise."""
    return detectability.precision_by_band(detectability.band_rates(base(spark, sf_dir)), (1.5, 2.0, 3.0))


#: Log-binomials for all n up to 1,000; the share of tables with n cases that the test rejects depends on the ratio alone, and so
#: does the ladder if it is counted in expected cases.
LOG_BINOMIAL = lambda k, p: f"lgamma(n + 1) - lgamma({k} + 1) - lgamma(n - {k} + 1) + {k} * ln({p}) + (n - {k}) * ln(1 - {p})"
LADDER = f"""
rr AS (SELECT * FROM (VALUES (1.25::DOUBLE), (1.5), (2.0)) v(ratio)), ns AS (SELECT CAST(n AS INTEGER) AS n FROM range(1, 1001) t(n)),
crit AS (SELECT n, max(c) AS c FROM (SELECT n, c, sum(exp({LOG_BINOMIAL('c', '0.5')})) OVER (PARTITION BY n ORDER BY c) AS f FROM ns, (SELECT CAST(c AS INTEGER) AS c FROM range(0, 500) u(c)) WHERE 2 * c < n) WHERE 2 * f <= 0.05 GROUP BY n),
rej AS (SELECT ratio, n, sum(exp({LOG_BINOMIAL('c', '(ratio / (1 + ratio))')}) + exp({LOG_BINOMIAL('c', '(1 / (1 + ratio))')})) AS p FROM (SELECT crit.n, unnest(range(0, crit.c + 1)) AS c FROM crit), rr GROUP BY ratio, n),
rung AS (SELECT ratio, CAST(j AS INTEGER) AS j, 0.5 * 2.801585e0 * 2.801585e0 * (1 + ratio) / ((ratio - 1) * (ratio - 1)) * pow(1.01::DOUBLE, j) AS m FROM rr, range(0, 160) t(j)),
pw AS (SELECT rung.ratio, j, sum(exp(n * ln(m * (1 + rung.ratio)) - m * (1 + rung.ratio) - lgamma(n + 1)) * p) AS power FROM rung JOIN rej ON rej.ratio = rung.ratio GROUP BY rung.ratio, j, m),
first_ AS (SELECT ratio, min(j) AS j FROM pw WHERE power >= 0.8 GROUP BY ratio),
one AS (SELECT band, rej.ratio, sum(exp(n * ln(mc * (1 + rej.ratio)) - mc * (1 + rej.ratio) - lgamma(n + 1)) * p) AS power FROM (SELECT band, mc FROM bd), rej GROUP BY band, rej.ratio),
hn AS (SELECT bd.*, f.ratio, f.j, pw.power, one.power AS single, greatest(1.0, 0.5 * 2.801585e0 * 2.801585e0 * 200000.0 * (rate + rate * f.ratio) / ((rate - rate * f.ratio) * (rate - rate * f.ratio))) * pow(1.01::DOUBLE, f.j) AS hours FROM bd, first_ f JOIN pw ON pw.ratio = f.ratio AND pw.j = f.j JOIN one ON one.ratio = f.ratio WHERE one.band = bd.band)"""


@query(f"SELECT band AS size_band, {r('ratio', 'ratio')}, {n('j', 'rung')}, {r('hours', 'hours')}, {r('power', 'power')}, {r('hours / mh', 'site_years')}, {r('single', 'power_of_one')} FROM hn", f"{BANDS}, {LADDER}")
def power_ladder(spark, sf_dir):
    """Hours that tell a band's rate from a multiple of it: the first rung of the ladder that reaches the power."""
    return detectability.power_by_band(detectability.band_rates(base(spark, sf_dir)))


@query("SELECT band AS size_band, " + ", ".join([n("n", "n_filings"), r("rate", "rate"), r("mc", "mean_cases"), r("mh", "mean_hours"), r("200000.0 * -ln(0.025) / mh", "upper_without_cases"), n("(SELECT cases FROM need WHERE ratio = 2)", "cases_precise"), r("(SELECT cases FROM need WHERE ratio = 2) * 200000.0 / rate", "hours_precise"), r("(SELECT cases FROM need WHERE ratio = 2) * 200000.0 / rate / mh", "site_years_precise"), *(x for v, t in ((1.25, "1_25"), (1.5, "1_5"), (2.0, "2")) for x in (r(f"max(single) FILTER (ratio = {v})", f"power_of_one_{t}"), r(f"max(hours / mh) FILTER (ratio = {v})", f"site_years_{t}")))]) + " FROM hn GROUP BY band, n, rate, mc, mh", f"{BANDS}, {PRECISION}, {LADDER}")
def detectability_by_band(spark, sf_dir):
    return detectability.detectability(base(spark, sf_dir))


#: Redraws in SQL: the law of each sector as a running sum, and for each number the first count that reaches it.
DRAWS = """
dr AS (SELECT wl.*, CAST(d AS INTEGER) AS d, CASE WHEN d > 0 THEN CAST(('0x' || substr(md5('1|' || d || '|' || naics3), 1, 13)) AS BIGINT) / 4503599627370496.0 END AS u FROM wl, range(0, 2001) t(d)),
law AS (SELECT naics3, j, sum(exp(lgamma(m + 1) - lgamma(j + 1) - lgamma(m - j + 1) + j * ln(k / m) + (m - j) * ln(1 - k / m))) OVER (PARTITION BY naics3 ORDER BY j) AS f FROM (SELECT naics3, m, k, unnest(range(0, CAST(m AS BIGINT) + 1)) AS j FROM wl WHERE k > 0 AND k < m)),
dk AS (SELECT d, naics3, m, k AS x FROM dr WHERE d = 0 OR k = 0 OR k = m UNION ALL SELECT d, dr.naics3, m, CAST(j AS DOUBLE) FROM (SELECT * FROM dr WHERE d > 0 AND k > 0 AND k < m) dr ASOF JOIN law ON dr.naics3 = law.naics3 AND dr.u <= law.f),
cu AS (SELECT d, sum(m) OVER o / sum(m) OVER (PARTITION BY d) AS x1, (sum(m) OVER o - m) / sum(m) OVER (PARTITION BY d) AS x0, sum(x) OVER o / greatest(sum(x) OVER (PARTITION BY d), 1) AS y1, (sum(x) OVER o - x) / greatest(sum(x) OVER (PARTITION BY d), 1) AS y0 FROM dk WINDOW o AS (PARTITION BY d ORDER BY x / m, naics3 ROWS UNBOUNDED PRECEDING)),
gi AS (SELECT d, 1 - sum((x1 - x0) * (y1 + y0)) AS g FROM cu GROUP BY d)"""


@query(f"SELECT {r('(SELECT g FROM gi WHERE d = 0)', 'gini')}, {r('quantile_cont(g, 0.025) FILTER (d > 0)', 'low')}, {r('quantile_cont(g, 0.975) FILTER (d > 0)', 'high')}, {n('count(*) FILTER (d > 0)', 'draws')} FROM gi", f"{WIL}, {DRAWS}")
def gini_bootstrap(spark, sf_dir):
    return detectability.gini_bootstrap(sectors.flag_counts(base(spark, sf_dir), "naics3").filter("naics3 is not null"), "k", "n", "naics3")


@query(f"SELECT {n('year_filing_for', 'year')}, {n('count(*)', 'n_filings')}, {r('avg(CASE WHEN bad THEN 1.0 ELSE 0.0 END)', 'implausible_share')}, {r('200000.0 * sum(' + NUM['trir'] + ') FILTER (NOT bad) / nullif(sum(hours) FILTER (NOT bad), 0)', 'trir_screened')}, {r('200000.0 * sum(' + NUM['severity'] + ') FILTER (NOT bad) / nullif(sum(hours) FILTER (NOT bad), 0)', 'severity_screened')} FROM screened GROUP BY year_filing_for")
def quality_with_metrics(spark, sf_dir):
    """Quality and rates of each year, joined where both have each year exactly once."""
    rows = base(spark, sf_dir)
    quality = rates.summarise(rows, "year_filing_for").select(F.col("year_filing_for").alias("year"), "n_filings", "implausible_share")
    metrics = rates.rates(rows, "year_filing_for").select(F.col("year_filing_for").alias("year"), "trir_screened", "severity_screened")
    return one_to_one(quality, metrics, ["year"])


def review_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a two-year review takes: filings with employees, hours and cases."""
    rows = base(spark, sf_dir).filter((F.col("total_hours_worked") > 0) & (F.col("annual_average_employees") > 0) & (F.col("recordable_cases") >= 0))
    return rows.select(F.col("year_filing_for").alias("year"), F.col("annual_average_employees").alias("employees"), F.col("total_hours_worked").alias("hours"), F.col("recordable_cases").alias("cases"), F.col("id").cast("string").alias("filing_id"))


REVIEW = """
ry AS (SELECT DISTINCT year_filing_for AS y FROM screened WHERE hours > 0 AND emp > 0 AND cases >= 0 ORDER BY y DESC LIMIT 2),
rv AS (SELECT year_filing_for AS year, year_filing_for || ':' || id AS key, hours, cases, hours / emp BETWEEN 120 AND 4500 AS ok FROM screened WHERE hours > 0 AND emp > 0 AND cases >= 0 AND year_filing_for IN (SELECT y FROM ry)),
rl AS (SELECT *, CASE WHEN ok THEN 200000.0 * sum(cases) FILTER (ok) OVER w / sum(hours) FILTER (ok) OVER w END AS rate, CASE WHEN ok THEN 200000.0 * (sum(cases) FILTER (ok) OVER w - cases) / nullif(sum(hours) FILTER (ok) OVER w - hours, 0) END AS wo, CASE WHEN ok THEN hours / sum(hours) FILTER (ok) OVER w END AS share FROM rv WINDOW w AS (PARTITION BY year)),
rr AS (SELECT *, CASE WHEN ok THEN row_number() OVER (PARTITION BY year, ok ORDER BY abs(wo - rate) DESC NULLS LAST, key) END AS rank FROM rl),
rt AS (SELECT max(rate) FILTER (year = (SELECT min(y) FROM ry)) AS r0, max(rate) FILTER (year = (SELECT max(y) FROM ry)) AS r1 FROM rl),
rx AS (SELECT *, ok AND rank = 1 AS gone FROM rr)"""


@query(f"SELECT key, {n('year', 'year')}, ok AS passes, {r('rate', 'rate')}, {r('wo', 'rate_without')}, {r('share', 'hours_share')}, {n('CASE WHEN rank <= 5 THEN rank END', 'top_rank')}, CASE WHEN ok THEN coalesce((CASE WHEN year = (SELECT min(y) FROM ry) THEN r1 - wo ELSE wo - r0 END) * (r1 - r0) < 0, false) END AS reverses FROM rr, rt", REVIEW)
def two_year_influence(spark, sf_dir):
    """Every row of the last two years: its year's rate without it, whether that turns the trend, and the five that move it most."""
    out = review.analyse(review_rows(spark, sf_dir))
    return out.select("key", "year", "passes", "rate", "rate_without", "hours_share", F.when(F.col("rank") <= 5, F.col("rank")).alias("top_rank"), "reverses")


def restored_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A review that sets aside the most influential row of each year, saved with the digest of the inputs and restored from that."""
    rows = review_rows(spark, sf_dir)
    first = review.analyse(rows)
    top = sorted((x.year, x.key) for x in first.filter("rank = 1").select("year", "key").collect())
    inputs = digest(manifest(spark, *(f"{sf_dir}/{t}.parquet" for t in ("orders", "lineitem", "customer"))))
    saved = review.save_review(inputs, tuple(y for y, _ in top), 120, 4500, tuple(k for _, k in top), "two rows set aside")
    return review.restore_review(rows, inputs, saved)[0]


@query(f"SELECT {n('year', 'year')}, {n('count(*)', 'n')}, {n('count(*) FILTER (ok)', 'accepted')}, {n('count(*) FILTER (NOT ok)', 'rejected')}, {n('count(*) FILTER (gone)', 'excluded')}, {r('max(rate)', 'rate')}, {r('200000.0 * sum(cases) FILTER (ok AND NOT gone) / sum(hours) FILTER (ok AND NOT gone)', 'review_rate')} FROM rx GROUP BY year", REVIEW)
def two_year_review(spark, sf_dir):
    return review.annual(restored_review(spark, sf_dir))


SCENES = {"loaded": "true", "screened": "ok", "reviewed": "ok AND NOT gone", "without_most_influential": "ok AND rank > 1"}


@query(f"SELECT scenario, {n('y0', 'year_from')}, {n('y1', 'year_to')}, {r('a', 'rate_from')}, {r('b', 'rate_to')}, {r('b - a', 'change')}, {r('100 * (b / nullif(a, 0) - 1)', 'change_pct')} FROM (SELECT scenario, min(year) AS y0, max(year) AS y1, min_by(v, year) AS a, max_by(v, year) AS b FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS scenario, year, 200000.0 * sum(cases) FILTER ({c}) / sum(hours) FILTER ({c}) AS v FROM rx GROUP BY year" for k, c in SCENES.items()) + ") GROUP BY scenario)", REVIEW)
def review_scenarios(spark, sf_dir):
    return review.scenario_rows(restored_review(spark, sf_dir))


TOP_RATE = "tf AS (SELECT naics2, count(*) AS n, count(*) FILTER (bad) AS k, sum(hours) FILTER (bad) AS fh FROM screened WHERE naics2 IS NOT NULL GROUP BY naics2 HAVING count(*) >= 100)"


@query(f"SELECT naics2, {n('n', 'n')}, {n('k', 'k')}, {r('k / n', 'flag_rate')}, {n('row_number() OVER (ORDER BY k / n DESC, naics2)', 'rank_by_rate')}, {n('row_number() OVER (ORDER BY coalesce(fh, 0) DESC, naics2)', 'rank_by_hours')} FROM tf QUALIFY row_number() OVER (ORDER BY k / n DESC, naics2) <= 3 OR row_number() OVER (ORDER BY coalesce(fh, 0) DESC, naics2) <= 3", TOP_RATE)
def top_flag_rates(spark, sf_dir):
    return sectors.top_flagged(base(spark, sf_dir), "naics2", 3, 100)
