"""Structured Streaming over filings: running sums by year for screened rates, and the latest filing of each establishment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewright.operators.derive import PER_HOURS, derived
from ratewright.operators.screen import Bounds, screened
from ratewright.sources.schema import filing_schema


def read_filings(spark: SparkSession, path: str, files_per_batch: int = 10) -> DataFrame:
    """New CSV files of a folder, on the canonical columns."""
    return spark.readStream.schema(filing_schema()).option("header", True).option("maxFilesPerTrigger", files_per_batch).csv(path)


def running_rates(stream: DataFrame, bounds: Bounds = Bounds()) -> DataFrame:
    """year, n, flagged, hours and cases of passing filings, and their rate; for output mode `complete` or `update`.

    State is one row for each year.
    """
    df = screened(derived(stream), bounds)
    good = ~F.col("implausible")
    out = df.groupBy(F.col("year_filing_for").alias("year")).agg(F.count("*").alias("n"), F.count_if(~good).alias("flagged"), F.sum(F.when(good, F.col("total_hours_worked"))).alias("hours"), F.sum(F.when(good, F.col("recordable_cases"))).alias("cases"))
    return out.withColumn("rate", PER_HOURS * F.col("cases") / F.when(F.col("hours") > 0, F.col("hours")))


def windowed_counts(stream: DataFrame, time: str, key: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by window of event time and key; rows later than `late` are dropped, and windows closed by then leave the state."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def latest_filings(stream: DataFrame) -> DataFrame:
    """The filing of the largest id of each establishment and year so far; for output mode `complete` or `update`."""
    columns = [c for c in stream.columns if c not in ("establishment_id", "year_filing_for")]
    return stream.groupBy("establishment_id", "year_filing_for").agg(F.max_by(F.struct(*columns), F.col("id")).alias("f")).select("establishment_id", "year_filing_for", "f.*")
