"""More queries over the filings view: audits, coverage, scenarios, what-ifs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratewright.functions import decimals
from ratewright.models import counts
from ratewright.operators import audit, explorer, panel, peers, rates, stability
from ratewright.plans.filings import AVG_RANK, CELLS, FIT_DATA, KIT, LOG_LAWS, ORACLE, QUERIES, SERIES, base, n, query, r, searched, store, table  # noqa: F401

COVER = "pg_ AS (SELECT naics3, count(*) AS n, sum(hours) AS h, coalesce(sum(cases), 0) AS c FROM screened WHERE NOT bad AND hours > 0 GROUP BY naics3), ch AS (SELECT naics3 FROM pg_ WHERE n >= 200 AND naics3 IS NOT NULL ORDER BY n DESC, naics3 LIMIT 10), cv AS (SELECT pg_.*, naics3 IN (SELECT naics3 FROM ch) AS f FROM pg_)"
PARTS = {
    "n_filings": "sum(n)", "n_groups": "count(*)", "n_groups_large": "count(*) FILTER (n >= 200)", "n_groups_fitted": "count(*) FILTER (f)", "n_groups_too_small": "count(*) FILTER (n < 200)", "n_groups_beyond_top": "count(*) FILTER (n >= 200) - count(*) FILTER (f)",
    "share_filings": "coalesce(sum(n) FILTER (f), 0) / sum(n)", "share_hours": "coalesce(sum(h) FILTER (f), 0) / sum(h)", "share_cases": "coalesce(sum(c) FILTER (f), 0) / sum(c)", "smallest_fitted": "min(n) FILTER (f)",
}


@query(" UNION ALL ".join(f"SELECT '{k}' AS statistic, {r(v, 'value')} FROM cv" for k, v in PARTS.items()), COVER)
def group_coverage(spark, sf_dir):
    return audit.group_coverage(base(spark, sf_dir))


SPREAD = "pe AS (SELECT establishment_id, count(DISTINCT year_filing_for) AS k, count(*) AS n FROM screened GROUP BY 1), bk AS (SELECT k, count(*) AS ids, sum(n) AS filings FROM pe GROUP BY k), yr AS (SELECT y0, y1 FROM (SELECT year_filing_for AS y0, lead(year_filing_for) OVER (ORDER BY year_filing_for) AS y1 FROM (SELECT DISTINCT year_filing_for FROM screened)) WHERE y1 IS NOT NULL)"


@query(f"SELECT 'appearances' AS section, 'ids_in_exactly_' || k || '_years' AS metric, {n('ids', 'value')}, {r('ids / (SELECT sum(ids) FROM bk)', 'share')} FROM bk UNION ALL SELECT 'appearances', 'filings_of_ids_in_exactly_' || k || '_years', CAST(filings AS BIGINT), round(filings / (SELECT sum(filings) FROM bk), 6) FROM bk UNION ALL SELECT 'linkage', 'ids_in_' || y0 || '_and_' || y1, count(*), round(count(*) / any_value(m.n), 6) FROM yr JOIN screened a ON a.year_filing_for = y0 JOIN screened b ON b.year_filing_for = y1 AND a.establishment_id = b.establishment_id JOIN (SELECT year_filing_for AS y, count(*) AS n FROM screened GROUP BY 1) m ON m.y = y0 GROUP BY y0, y1", SPREAD)
def panel_audit(spark, sf_dir):
    return audit.panel_audit(panel.flag_panel(base(spark, sf_dir)))


CONCENTRATION = """
al AS (SELECT sum(coalesce(hours, 0)) AS h, sum(coalesce(hours, 0)) FILTER (bad) AS fh, count(*) FILTER (bad) AS f, max(coalesce(hours, 0)) AS top FROM screened),
fifty AS (SELECT sum(x) AS x, count(DISTINCT establishment_id) AS ids FROM (SELECT coalesce(hours, 0) AS x, establishment_id FROM screened WHERE bad ORDER BY x DESC, id LIMIT 50)),
per AS (SELECT establishment_id, count(DISTINCT year_filing_for) AS ny, count(*) FILTER (bad) AS nf FROM screened GROUP BY 1),
ys AS (SELECT DISTINCT year_filing_for AS y FROM screened), nx AS (SELECT y, lead(y) OVER (ORDER BY y) AS z FROM ys),
pr AS (SELECT nx.y, nx.z, a.bad AS was, b.bad AS is_ FROM nx JOIN screened a ON a.year_filing_for = nx.y JOIN screened b ON b.year_filing_for = nx.z AND b.establishment_id = a.establishment_id),
ends AS (SELECT y, count(*) FILTER (was) AS m FROM pr GROUP BY y UNION ALL SELECT z, count(*) FILTER (is_) FROM pr GROUP BY z), low AS (SELECT sum(m) AS b FROM (SELECT max(m) AS m FROM ends GROUP BY y)),
au AS (SELECT 'flagged_hours_in_' || year_filing_for AS metric, coalesce(sum(coalesce(hours, 0)) FILTER (bad), 0) AS v, coalesce(sum(coalesce(hours, 0)) FILTER (bad), 0) / (SELECT fh FROM al) AS s, 'answered' AS status FROM screened GROUP BY year_filing_for
  UNION ALL SELECT 'hours_of_the_largest_filing', top, top / h, 'answered' FROM al UNION ALL SELECT 'hours_of_the_50_largest_flagged', x, x / h, 'answered' FROM al, fifty UNION ALL SELECT 'ids_of_the_50_largest_flagged', ids, NULL, 'answered' FROM fifty
  UNION ALL SELECT 'flagged_filings', f, NULL, 'answered' FROM al UNION ALL SELECT 'flagged_filings_of_single_year_ids', s, s / f, 'answered' FROM al, (SELECT sum(nf) FILTER (ny = 1) AS s FROM per)
  UNION ALL SELECT 'flagged_filings_of_single_year_ids_at_most', f - b, (f - b) / f, 'partial_bound' FROM al, low UNION ALL SELECT 'flagged_filings_of_multi_year_ids_at_least', b, b / f, 'partial_bound' FROM al, low
  UNION ALL SELECT 'flagged_filings_without_id', (SELECT count(*) FROM screened WHERE bad AND establishment_id IS NULL), (SELECT count(*) FROM screened WHERE bad AND establishment_id IS NULL) / f, 'not_answerable' FROM al)
"""


@query("SELECT 'correction_concentration' AS section, metric, round(CAST(v AS DOUBLE), 2) AS value, round(CAST(s AS DOUBLE), 6) AS share, status FROM au", CONCENTRATION, plain=True)
def concentration_audit(spark, sf_dir):
    return audit.concentration_audit(base(spark, sf_dir)).withColumns({"value": F.round("value", 2), "share": F.round("share", 6)})


def scenario_sql(name: str, condition: str) -> str:
    return f"SELECT '{name}' AS scenario, y0, y1, sum((w0 + w1) / 2 * (r1 - r0)) AS within_, sum((r0 + r1) / 2 * (w1 - w0)) AS composition, count(*) AS cells FROM (SELECT *, h0 / sum(h0) OVER (PARTITION BY y0, y1) AS w0, h1 / sum(h1) OVER (PARTITION BY y0, y1) AS w1 FROM (SELECT * FROM both_ WHERE {condition})) GROUP BY y0, y1"


KIT_CELLS = KIT[: KIT.index(", zz AS")]


@query(f"SELECT scenario, {n('y0', 'year_from')}, {n('y1', 'year_to')}, {r('within_', 'within_effect')}, {r('composition', 'composition_effect')}, {n('cells', 'n_cells_matched')} FROM ({scenario_sql('all_cells', 'true')} UNION ALL {scenario_sql('without_310', chr(39) + '310' + chr(39) + ' <> naics3')} UNION ALL {scenario_sql('without_large', 'NOT (band = ' + chr(39) + '250-499' + chr(39) + ')')})", KIT_CELLS)
def decomposition_scenarios(spark, sf_dir):
    named = {"without_310": F.col("naics3") != "310", "without_large": F.col("size_band") != "250-499"}
    return audit.scenarios(table(spark, sf_dir, cuts=False), named).select("scenario", "year_from", "year_to", "within_effect", "composition_effect", "n_cells_matched")


@query(f"SELECT {n('y', 'year')}, {n('n', 'n_cells')}, {r('rc', 'rate_cells')}, true AS agrees FROM (SELECT year_filing_for AS y, sum(n) AS n, 200000.0 * sum(c) / sum(h) AS rc FROM cells GROUP BY 1)", CELLS)
def cell_reconciliation(spark, sf_dir):
    rows = base(spark, sf_dir).filter(F.col("naics3").isNotNull())
    return audit.reconciled(audit.validate_cells(peers.percentile_table(rows, cuts=False)), rows).select("year", "n_cells", "rate_cells", "agrees")


@query(f"SELECT naics3, {r('f', 'forecast')}, {r('o', 'observed')}, CASE WHEN o IS NULL OR lo IS NULL THEN 'not evaluable' WHEN o BETWEEN lo AND hi THEN 'held' ELSE 'not held' END AS verdict FROM (SELECT naics3, f, f - 2.4469 * e AS lo, f + 2.4469 * e AS hi, o FROM (SELECT naics3, avg(v) FILTER (place <= 3) AS f, sqrt(avg(miss * miss)) AS e FROM ro GROUP BY 1) LEFT JOIN (SELECT naics3, v AS o FROM full_ WHERE year = (SELECT max(year) FROM full_)) USING (naics3))", SERIES.replace("WHERE NOT bad GROUP BY 1, 2)", "WHERE NOT bad AND year_filing_for < (SELECT max(year_filing_for) FROM screened) GROUP BY 1, 2), full_ AS (SELECT naics3, year_filing_for AS year, 200000.0 * sum(cases) / sum(hours) AS v FROM screened WHERE NOT bad GROUP BY 1, 2)", 1))
def forecast_scores(spark, sf_dir):
    good = base(spark, sf_dir).filter(~F.col("implausible")).groupBy("naics3", F.col("year_filing_for").alias("year")).agg(rates.pooled_rate(F.sum("recordable_cases"), F.sum("total_hours_worked")).alias("value"))
    last = good.agg(F.max("year").alias("last"))
    split = good.join(F.broadcast(last))
    made = stability.rolling_forecast(split.filter("year < last"), "naics3", "year", "value")
    return audit.score_forecasts(made, split.filter("year = last"), "naics3").select("naics3", "forecast", "observed", "verdict")


@query(f"SELECT band AS size_band, {n('count(*)', 'n')}, {n('count(*) FILTER (hpe * 1000.0 BETWEEN 120 AND 4500)', 'passes_still')}, {r('avg(trir / 1000.0)', 'mean_trir_entered')} FROM keyed WHERE NOT bad GROUP BY band")
def typo_what_if(spark, sf_dir):
    return audit.typo_what_if(base(spark, sf_dir))


SHOWN = ("aggregate_trir", "zero_share", "p10", "p50", "p95")


@query(f"SELECT {n('year_filing_for', 'year')}, naics3, band AS size_band, {n('n', 'n')}, pub AS publishable, round(rate, 4) AS aggregate_trir, round(zero, 4) AS zero_share, {', '.join(f'round({p}, 4) AS {p}' for p in ('p10', 'p50', 'p95'))} FROM cells", CELLS, plain=True)
def explorer_payload(spark, sf_dir):
    """Every number of the documents for static pages, read back from their JSON."""
    made = audit.explorer_payload(table(spark, sf_dir))
    cell = "size_band: string, n: bigint, publishable: boolean, " + ", ".join(f"{c}: double" for c in SHOWN)
    groups = made.select(F.col("year").cast("long").alias("year"), F.explode(F.from_json("payload", f"array<struct<naics3: string, bands: array<struct<{cell}>>>>")).alias("g"))
    return groups.select("year", "g.naics3", F.explode("g.bands").alias("b")).select("year", "naics3", "b.size_band", "b.n", "b.publishable", *(f"b.{c}" for c in SHOWN))


GRAPH = """
pgs AS (SELECT naics3 || '|' || band AS g, any_value(naics3) AS naics3 FROM keyed WHERE NOT bad AND band IS NOT NULL AND naics3 IS NOT NULL GROUP BY 1),
ind AS (SELECT DISTINCT naics3, naics2 FROM screened WHERE naics3 IS NOT NULL),
nodes AS (SELECT 'Sector:' || naics2 AS seed, 0 AS distance, 'Sector' AS kind, naics2 AS key FROM (SELECT DISTINCT naics2 FROM ind) UNION ALL SELECT 'Sector:' || naics2, 1, 'Industry', naics3 FROM ind UNION ALL SELECT 'Sector:' || naics2, 2, 'PeerGroup', g FROM pgs JOIN ind USING (naics3)),
edges AS (SELECT 'Sector:' || naics2 AS seed, 'in_sector' AS link, naics3 AS source, naics2 AS target FROM ind UNION ALL SELECT 'Sector:' || naics2, 'group_industry', g, naics3 FROM pgs JOIN ind USING (naics3))"""


@query("SELECT seed, 'node' AS part, kind AS label, key AS a, CAST(distance AS VARCHAR) AS b FROM nodes UNION ALL SELECT seed, 'edge', link, source, target FROM edges", GRAPH)
def graph_payload(spark, sf_dir):
    """Two steps around every sector, over industries and peer groups: nodes and edges, read back from the documents' JSON."""
    s = store(spark, sf_dir)
    chosen = s.current("Sector").filter("naics2 is not null").select(F.lit("Sector").alias("kind"), F.col("naics2").alias("key"))
    made = explorer.documents(*explorer.neighbourhood(s, chosen, 2, ("in_sector", "group_industry")))
    parsed = F.from_json("payload", "nodes array<struct<distance: string, kind: string, key: string>>, edges array<struct<link: string, source: string, target: string>>")
    rows = made.select("seed", parsed.alias("p"))
    nodes = rows.select("seed", F.explode("p.nodes").alias("x")).select("seed", F.lit("node").alias("part"), F.col("x.kind").alias("label"), F.col("x.key").alias("a"), F.col("x.distance").alias("b"))
    return nodes.unionByName(rows.select("seed", F.explode("p.edges").alias("x")).select("seed", F.lit("edge").alias("part"), F.col("x.link").alias("label"), F.col("x.source").alias("a"), F.col("x.target").alias("b")))


#: Decimal texts of every order: m whole part, f the fraction in w digits, e the exponent; some are next to the bound.
TEXTS = """
dt AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 9007199254740991 + (o_orderkey % 3 - 1) ELSE (o_orderkey * 7919) % 100000 END AS m, o_orderkey % 7 AS w, CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE (o_orderkey * 31) % (10 ** (o_orderkey % 7))::BIGINT END AS f, o_orderkey % 11 - 5 AS e FROM orders),
dn AS (SELECT *, m || CASE WHEN w > 0 THEN '.' || lpad(CAST(f AS VARCHAR), CAST(w AS INTEGER), '0') ELSE '' END || CASE WHEN e <> 0 THEN 'e' || e ELSE '' END AS text, CAST(m AS HUGEINT) * CAST(10 ** w AS HUGEINT) + f AS d, e - w AS p FROM dt)"""


@query("SELECT id, text, CASE WHEN p >= 0 THEN true ELSE d % CAST(10 ** -p AS HUGEINT) = 0 END AS whole, CASE WHEN p >= 0 THEN d * CAST(10 ** p AS HUGEINT) > 9007199254740991 ELSE d > 9007199254740991 * CAST(10 ** -p AS HUGEINT) END AS unsafe FROM dn", TEXTS, plain=True)
def decimal_texts(spark, sf_dir):
    """Whole and too large numbers among decimal texts, by their digits; SQL has them from 128-bit numbers."""
    key = F.col("o_orderkey")
    m = F.when(key % 5 == 0, F.lit(9007199254740991) + (key % 3 - 1)).otherwise((key * 7919) % 100000)
    w = key % 7
    f = F.when(key % 2 == 0, F.lit(0)).otherwise((key * 31) % F.pow(F.lit(10.0), w).cast("long")).cast("string")
    fraction = F.when(w > 0, F.concat(F.lit("."), F.lpad(f, w.cast("int"), F.lit("0")))).otherwise(F.lit(""))
    e = key % 11 - 5
    text = F.concat(m.cast("string"), fraction, F.when(e != 0, F.concat(F.lit("e"), e.cast("string"))).otherwise(F.lit("")))
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(key.alias("id"), text.alias("text"))
    return rows.select("id", "text", decimals.is_whole(F.col("text")).alias("whole"), decimals.is_unsafe(F.col("text")).alias("unsafe"))


EXPECTED = f"""
every AS ({" UNION ALL ".join(f"SELECT {i} AS place, '{m}' AS model, * FROM {m}_best" for i, m in enumerate(counts.MODELS))}),
chosen AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY naics3 ORDER BY 2 * k - 2 * ll, place) = 1),
ex AS (SELECT y, sum(w * exp(CASE model {' '.join(f"WHEN '{m}' THEN {law}" for m, law in LOG_LAWS.items())} END)) AS x FROM chosen JOIN (SELECT naics3, e, w FROM dat) USING (naics3), (SELECT CAST(y AS DOUBLE) AS y FROM range(0, 10) t(y)) GROUP BY y),
seen AS (SELECT least(y, 10) AS y, sum(w) AS o FROM dat GROUP BY 1)"""


@query("SELECT CAST(h.y AS BIGINT) AS sort_key, coalesce(o, 0) AS observed, round(coalesce(x, (SELECT sum(w) FROM dat) - (SELECT sum(x) FROM ex)), 1) AS expected FROM (SELECT CAST(y AS DOUBLE) AS y FROM range(0, 11) t(y)) h LEFT JOIN ex ON ex.y = h.y LEFT JOIN seen ON seen.y = h.y", ", ".join([FIT_DATA, *map(searched, counts.MODELS), EXPECTED]))
def predicted_counts(spark, sf_dir):
    """Filings by number of cases, seen and expected under each industry's best model, all industries together."""
    return counts.predicted_histogram(base(spark, sf_dir)).withColumn("expected", F.round("expected", 1))
