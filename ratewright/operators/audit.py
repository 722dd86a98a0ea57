"""Audits of result tables: peer cells that must add up, decomposition under scenarios, what panels and fits leave out, forecasts held to account."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewright.operators.influence import KEYS, kitagawa
from ratewright.operators.panel import paired
from ratewright.operators.rates import pooled_rate, ratio


def validate_cells(table: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """The table with cases made whole from its rates; raises for null or repeated keys, and for cases that aren't whole."""
    keys = ["year_filing_for", *KEYS]
    cases = F.col("aggregate_trir") * F.col("hours_total") / 200_000
    found = table.agg(F.count_if(reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))).alias("nulls"), (F.count("*") - F.count_distinct(*keys)).alias("twice"), F.count_if(F.abs(cases - F.round(cases)) > tolerance * F.greatest(F.lit(1.0), cases)).alias("broken"), F.count_if(~F.coalesce(F.col("hours_total") > 0, F.lit(False))).alias("hours")).first()
    if found.nulls or found.broken or found.hours or found.twice > found.nulls:
        raise ValueError(f"peer cells: {found.nulls} null keys, {found.twice} repeated, {found.broken} without whole cases, {found.hours} without hours")
    return table.withColumn("cases_total", F.round(cases))


def reconciled(table: DataFrame, screened: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """year, rate of the cells, rate of the screened filings with a cell, and whether they agree."""
    cells = table.groupBy(F.col("year_filing_for").alias("year")).agg(F.sum("n").alias("n_cells"), pooled_rate(F.sum("cases_total"), F.sum("hours_total")).alias("rate_cells"))
    rows = screened.filter(~F.col("implausible")).groupBy(F.col("year_filing_for").alias("year")).agg(F.count("*").alias("n_filings"), pooled_rate(F.sum("recordable_cases"), F.sum("total_hours_worked")).alias("rate_filings"))
    same = (F.col("n_cells") == F.col("n_filings")) & (F.abs(F.col("rate_cells") - F.col("rate_filings")) <= tolerance * F.col("rate_filings"))
    return cells.join(rows, "year").withColumn("agrees", same)


def scenarios(table: DataFrame, named: dict[str, Column]) -> DataFrame:
    """The decomposition over all cells, and over those that each named condition keeps."""
    parts = [kitagawa(table.filter(c)).withColumn("scenario", F.lit(n)) for n, c in ({"all_cells": F.lit(True)} | named).items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def healthcare_scenarios() -> dict[str, Column]:
    """Publishable cells; without the largest nursing homes; without nursing homes; without health care."""
    return {"publishable": F.col("publishable"), "without_623_1000plus": ~((F.col("naics3") == "623") & (F.col("size_band") == "1000+")), "without_623": F.col("naics3") != "623", "without_621_622_623": ~F.col("naics3").isin("621", "622", "623")}


def group_coverage(df: DataFrame, top: int = 10, least: int = 200) -> DataFrame:
    """statistic, value: how many industries a fit of the `top` largest reaches, and what share of filings, hours and cases."""
    good = df.filter(~F.col("implausible") & (F.col("total_hours_worked") > 0))
    per = good.groupBy("naics3").agg(F.count("*").alias("n"), F.sum("total_hours_worked").alias("h"), F.coalesce(F.sum("recordable_cases"), F.lit(0.0)).alias("c"))
    named = per.filter("naics3 is not null")
    chosen = named.filter(F.col("n") >= least).orderBy(F.col("n").desc(), "naics3").limit(top).select("naics3", F.lit(1).alias("fitted"))
    x = per.join(F.broadcast(chosen), "naics3", "left")
    has, big, fit = F.col("naics3").isNotNull(), F.col("n") >= least, F.col("fitted") == 1
    stats = {
        "n_filings": F.sum("n"), "n_groups": F.count_if(has), "n_groups_large": F.count_if(has & big), "n_groups_fitted": F.count("fitted"), "n_groups_too_small": F.count_if(has & ~big), "n_groups_beyond_top": F.count_if(has & big) - F.count("fitted"),
        "share_filings": ratio(F.sum(F.when(fit, F.col("n")).otherwise(0)).cast("double"), F.sum("n")), "share_hours": ratio(F.sum(F.when(fit, F.col("h")).otherwise(0.0)), F.sum("h")), "share_cases": ratio(F.sum(F.when(fit, F.col("c")).otherwise(0.0)), F.sum("c")), "smallest_fitted": F.min(F.when(fit, F.col("n"))),
    }
    one = x.agg(*(v.cast("double").alias(k) for k, v in stats.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("statistic"), F.col(k).alias("value")) for k in stats))).alias("r")).select("r.*")


def panel_audit(panel: DataFrame) -> DataFrame:
    """section, metric, value, share: how ids spread over years, and how many of a year's filers file in the next."""
    per = panel.groupBy("establishment_id").agg(F.count_distinct("year").alias("k"), F.count("*").alias("n"))
    by_k = per.groupBy("k").agg(F.count("*").alias("ids"), F.sum("n").alias("filings"))
    total = by_k.agg(F.sum("ids").alias("ti"), F.sum("filings").alias("tf"))
    spread = by_k.join(F.broadcast(total)).select(F.explode(F.array(
        F.struct(F.lit("appearances").alias("section"), F.concat(F.lit("ids_in_exactly_"), F.col("k"), F.lit("_years")).alias("metric"), F.col("ids").alias("value"), (F.col("ids") / F.col("ti")).alias("share")),
        F.struct(F.lit("appearances").alias("section"), F.concat(F.lit("filings_of_ids_in_exactly_"), F.col("k"), F.lit("_years")).alias("metric"), F.col("filings").alias("value"), (F.col("filings") / F.col("tf")).alias("share")),
    )).alias("r")).select("r.*")
    n = panel.groupBy(F.col("year").alias("year_from")).agg(F.count("*").alias("n"))
    links = paired(panel).groupBy("year_from", "year_to").agg(F.count("*").alias("m")).join(F.broadcast(n), "year_from")
    links = links.select(F.lit("linkage").alias("section"), F.concat(F.lit("ids_in_"), F.col("year_from"), F.lit("_and_"), F.col("year_to")).alias("metric"), F.col("m").alias("value"), (F.col("m") / F.col("n")).alias("share"))
    return spread.unionByName(links)


def concentration_audit(df: DataFrame) -> DataFrame:
    """section, metric, value, share, status: where flagged filings and their hours lie.

    Flagged hours by year, all hours of the largest filing and of the fifty largest flagged ones, and how many flagged
    filings come from ids of one year only. That number is counted (`answered`); beside it stands the bound that
    follows from pairs of years alone (`partial_bound`), for readers who have no more. What ids without a number do
    can't be told (`not_answerable`).
    """
    flagged, hours = F.col("implausible"), F.coalesce("total_hours_worked", F.lit(0.0))
    row = lambda metric, value, share, status="answered": F.struct(F.lit("correction_concentration").alias("section"), metric.alias("metric"), value.cast("double").alias("value"), share.cast("double").alias("share"), F.lit(status).alias("status"))
    all_ = df.agg(F.sum(hours).alias("h"), F.sum(F.when(flagged, hours)).alias("fh"), F.count_if("implausible").alias("f"), F.max(hours).alias("top"))
    year = df.groupBy("year_filing_for").agg(F.coalesce(F.sum(F.when(flagged, hours)), F.lit(0.0)).alias("yh"))
    by_year = year.join(F.broadcast(all_)).select(row(F.concat(F.lit("flagged_hours_in_"), F.col("year_filing_for")), F.col("yh"), F.col("yh") / F.col("fh")).alias("r"))
    fifty = df.filter(flagged).select(hours.alias("x"), "establishment_id", "id").orderBy(F.col("x").desc(), "id").limit(50).agg(F.sum("x").alias("x"), F.count_distinct("establishment_id").alias("ids"))
    none = F.lit(None)
    largest = all_.join(F.broadcast(fifty)).select(F.explode(F.array(
        row(F.lit("hours_of_the_largest_filing"), F.col("top"), F.col("top") / F.col("h")), row(F.lit("hours_of_the_50_largest_flagged"), F.col("x"), F.col("x") / F.col("h")),
        row(F.lit("ids_of_the_50_largest_flagged"), F.col("ids"), none), row(F.lit("flagged_filings"), F.col("f"), none),
    )).alias("r"))
    panel = df.filter("establishment_id is not null and year_filing_for is not null").select("establishment_id", F.col("year_filing_for").alias("year"), flagged.cast("int").alias("flag"))
    per = panel.groupBy("establishment_id").agg(F.count_distinct("year").alias("years"), F.sum("flag").alias("flags"))
    single = per.agg(F.coalesce(F.sum(F.when(F.col("years") == 1, F.col("flags"))), F.lit(0)).alias("s"))
    pairs = paired(panel)
    ends = pairs.groupBy(F.col("year_from").alias("year"), F.lit("after").alias("side")).agg(F.sum("was").alias("m")).unionByName(pairs.groupBy(F.col("year_to").alias("year"), F.lit("before").alias("side")).agg(F.sum("is").alias("m")))
    least = ends.groupBy("year").agg(F.max("m").alias("m")).agg(F.coalesce(F.sum("m"), F.lit(0)).alias("b"))
    missing = df.agg(F.count_if(flagged & F.col("establishment_id").isNull()).alias("u"))
    known = all_.join(F.broadcast(single)).join(F.broadcast(least)).join(F.broadcast(missing)).select(F.explode(F.array(
        row(F.lit("flagged_filings_of_single_year_ids"), F.col("s"), F.col("s") / F.col("f")), row(F.lit("flagged_filings_of_single_year_ids_at_most"), F.col("f") - F.col("b"), (F.col("f") - F.col("b")) / F.col("f"), "partial_bound"),
        row(F.lit("flagged_filings_of_multi_year_ids_at_least"), F.col("b"), F.col("b") / F.col("f"), "partial_bound"), row(F.lit("flagged_filings_without_id"), F.col("u"), F.col("u") / F.col("f"), "not_answerable"),
    )).alias("r"))
    return by_year.unionByName(largest).unionByName(known).select("r.*")


def score_forecasts(forecasts: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """key, forecast, low, high, observed, verdict: held, not held, or not evaluable."""
    out = forecasts.join(observed.select(key, F.col("value").alias("observed")), key, "left")
    verdict = F.when(F.col("observed").isNull() | F.col("low").isNull(), "not evaluable").when(F.col("observed").between(F.col("low"), F.col("high")), "held").otherwise("not held")
    return out.select(key, "forecast", "low", "high", "observed", verdict.alias("verdict"))


def series_hash(df: DataFrame, order: str, value: str) -> DataFrame:
    """SHA-256 of a series as text, values to nine places, in order: what a preregistration pins."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.format_string("%.9f", F.col(value)).alias("v"))))
    return df.agg(F.sha2(F.array_join(F.transform(listed, lambda x: x["v"]), ";"), 256).alias("sha256"))


def typo_what_if(df: DataFrame, factor: float = 1000.0) -> DataFrame:
    """Plausible filings if their hours had been entered `factor` times too large: how many the screen would still pass, by band."""
    from ratewright.operators.derive import size_band
    from ratewright.operators.screen import Bounds

    b = Bounds()
    good = df.filter(~F.col("implausible")).withColumn("size_band", size_band(F.col("annual_average_employees")))
    wrong = F.col("hours_per_employee") * factor
    return good.groupBy("size_band").agg(F.count("*").alias("n"), F.count_if((wrong >= b.low) & (wrong <= b.high)).alias("passes_still"), F.avg(F.col("trir") / factor).alias("mean_trir_entered"))


def hash_sample(df: DataFrame, key: str, most: int, seed: int = 1) -> DataFrame:
    """At most `most` rows, those of the least hash of their key and seed: the same rows each time. A sampling operator."""
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(most)


def explorer_payload(table: DataFrame) -> DataFrame:
    """year, payload: a JSON document for each year with its industries, bands and percentiles, for static pages."""
    cell = F.struct("size_band", "n", "publishable", *(F.round(c, 4).alias(c) for c in ("aggregate_trir", "zero_share", "p10", "p25", "p50", "p75", "p90", "p95")))
    by = table.groupBy("year_filing_for", "naics3").agg(F.array_sort(F.collect_list(cell)).alias("bands"))
    return by.groupBy(F.col("year_filing_for").alias("year")).agg(F.to_json(F.array_sort(F.collect_list(F.struct("naics3", "bands")))).alias("payload"))
