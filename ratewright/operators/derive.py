"""Derived columns of filings, deduplication, size bands and peer keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewright.sources.schema import CASES

PER_HOURS = 200_000.0

#: Lower edges of the size bands (employees), and their names.
BAND_EDGES = (1, 20, 50, 100, 250, 500, 1000)
BAND_LABELS = ("001-019", "020-049", "050-099", "100-249", "250-499", "500-999", "1000+")


def derived(df: DataFrame) -> DataFrame:
    """Adds recordable_cases, dart_cases, hours_per_employee, trir, dart_rate and NAICS prefixes.

    Case totals are null if any part is; ratios are null unless their denominator is above 0; a prefix is null if
    the code is shorter than it.
    """
    cases, dart = reduce(lambda a, b: a + b, map(F.col, CASES)), F.col("total_dafw_cases") + F.col("total_djtr_cases")
    code = F.col("naics_code").cast("long").cast("string")
    prefix = lambda n: F.when(F.length(code) >= n, F.substring(code, 1, n))
    hours = F.col("total_hours_worked")
    return df.withColumns({"recordable_cases": cases, "dart_cases": dart}).withColumns({
        "hours_per_employee": hours / F.when(F.col("annual_average_employees") > 0, F.col("annual_average_employees")),
        "trir": PER_HOURS * F.col("recordable_cases") / F.when(hours > 0, hours), "dart_rate": PER_HOURS * F.col("dart_cases") / F.when(hours > 0, hours),
        "naics2": prefix(2), "naics3": prefix(3), "naics4": prefix(4),
    })


def deduplicated(df: DataFrame, *ties: str) -> DataFrame:
    """The last filing by id of each establishment and year; a missing id counts as last, missing keys as one key."""
    if "establishment_id" not in df.columns or "year_filing_for" not in df.columns:
        return df
    keys = ["establishment_id", "year_filing_for"]
    order = F.struct(*([F.col("id").isNull(), "id"] if "id" in df.columns else []), *ties, F.lit(0))
    # the last one so far is kept where rows are read, so that keys with very many filings, a missing one too, move few
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in df.columns if c not in keys)), order).alias("last"))
    return last.select(*(c if c in keys else F.col("last")[c].alias(c) for c in df.columns))


def size_band(employees: Column, edges: tuple[float, ...] = BAND_EDGES, labels: tuple[str, ...] = BAND_LABELS) -> Column:
    """The band whose lower edge is reached and whose upper one isn't; null below the first edge and for null."""
    if len(edges) != len(labels):
        raise ValueError("each band needs one edge and one label")
    out = F.when(employees < edges[0], F.lit(None).cast("string"))
    for upper, label in zip(edges[1:], labels, strict=False):
        out = out.when(employees < upper, label)
    return out.when(employees >= edges[-1], labels[-1])


def band_rank(band: Column) -> Column:
    """Place of a band in order of size, from 0."""
    return F.array_position(F.array(*map(F.lit, BAND_LABELS)), band) - 1


def with_peer_keys(df: DataFrame, naics_level: int = 3) -> DataFrame:
    """Adds size_band and peer_group (NAICS prefix and band, null if either is)."""
    if naics_level not in (2, 3, 4):
        raise KeyError(f"no NAICS prefix of {naics_level} digits")
    df = df.withColumn("size_band", size_band(F.col("annual_average_employees")))
    return df.withColumn("peer_group", F.concat(f"naics{naics_level}", F.lit("|"), "size_band"))
