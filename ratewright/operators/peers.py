"""Peer groups: percentile tables, coverage, and where a filing stands in its group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewright.operators.derive import with_peer_keys
from ratewright.operators.ranks import percentiles
from ratewright.operators.rates import pooled_rate

PERCENTILES = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95}


def percentile_table(df: DataFrame, by: tuple[str, ...] = ("year_filing_for",), naics_level: int = 3, least: int = 30, plausible_only: bool = True, cuts: bool = True) -> DataFrame:
    """One row for each peer group (and `by`): n, with_metric, zero_share, hours, cases, rate, exact percentiles, publishable.

    Without `cuts` the percentiles, which take passes of their own, are left out.
    """
    df = with_peer_keys(df.filter(~F.col("implausible")) if plausible_only else df, naics_level)
    keys = [*by, f"naics{naics_level}", "size_band"]
    for k in keys:
        df = df.filter(F.col(k).isNotNull())
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), F.count("trir").alias("n_with_metric"), F.avg(F.when(F.col("recordable_cases") == 0, 1.0).otherwise(0.0)).alias("zero_share"), F.sum("total_hours_worked").alias("hours_total"), F.sum("recordable_cases").alias("cases_total"), pooled_rate(F.sum("recordable_cases"), F.sum("total_hours_worked")).alias("aggregate_trir"))
    if cuts:
        out = out.join(percentiles(df, keys, "trir", PERCENTILES.values()).drop("n_values"), keys, "left")
    return out.select(*keys, "n", "n_with_metric", "zero_share", "hours_total", "cases_total", "aggregate_trir", *(F.get("cuts", F.lit(i)).alias(p) for i, p in enumerate(PERCENTILES) if cuts), (F.col("n_with_metric") >= least).alias("publishable"))


def coverage(table: DataFrame) -> DataFrame:
    """Groups and filings in all, and in groups large enough to publish."""
    ok = F.col("publishable")
    return table.agg(F.count("*").alias("groups"), F.count_if(ok).alias("groups_publishable"), F.sum("n").alias("filings"), F.sum(F.when(ok, F.col("n")).otherwise(0)).alias("filings_publishable"), (F.count_if(ok) / F.count("*")).alias("share_groups"), (F.sum(F.when(ok, F.col("n")).otherwise(0)) / F.sum("n")).alias("share_filings"))


def place(value: Column, cuts: list[Column], upper: bool = True) -> Column:
    """How many cuts a value reaches; one equal to a cut belongs above it, or below it without `upper`."""
    return sum((F.coalesce(value >= c if upper else value > c, F.lit(False)).cast("int") for c in cuts), F.lit(0))


def peer_position(df: DataFrame, table: DataFrame, naics_level: int = 3, excluded: Column | None = None, upper: bool = True) -> DataFrame:
    """id, status, band of each filing: excluded, no_rate, no_peer_group, not_publishable, or placed between percentiles.

    The table has a row for each peer group and goes to every task.
    """
    df = with_peer_keys(df, naics_level)
    out = df.join(table.select("year_filing_for", f"naics{naics_level}", "size_band", *PERCENTILES, "publishable"), ["year_filing_for", f"naics{naics_level}", "size_band"], "left")
    gone = F.col("implausible") if excluded is None else F.col("implausible") | excluded
    status = F.when(gone, "excluded").when(F.col("trir").isNull(), "no_rate").when(F.col("peer_group").isNull(), "no_peer_group").when(~F.coalesce("publishable", F.lit(False)), "not_publishable").otherwise("placed")
    names = ["below p10", *(f"{a} to {b}" for a, b in zip(PERCENTILES, [*PERCENTILES][1:], strict=False)), "p95 and above"]
    band = F.element_at(F.array(*map(F.lit, names)), place(F.col("trir"), [F.col(p) for p in PERCENTILES], upper) + 1)
    return out.withColumn("status", status).select("id", "status", F.when(F.col("status") == "placed", band).alias("band"))
