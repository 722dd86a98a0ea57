"""Quality by sector: shares with intervals, sectors without the largest implausible filings, concentration of flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratewright.functions.stats import wilson
from ratewright.operators.derive import PER_HOURS
from ratewright.operators.rates import ratio, summarise


def top_high(df: DataFrame, most: int = 50) -> DataFrame:
    """The filings of largest hours among those with too many hours per employee; ties by id."""
    return df.filter("flag_hours_per_employee_high").orderBy(F.col("total_hours_worked").desc(), "id").limit(most)


def wilson_by(df: DataFrame, key: str) -> DataFrame:
    """k of n filings implausible by group, with the interval and where it lies against all filings together."""
    groups = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.count_if("implausible").alias("k"))
    whole = df.agg((F.count_if("implausible") / F.count("*")).alias("pooled"))
    low, high = wilson(F.col("k"), F.col("n"))
    out = groups.withColumns({"low": low, "high": high}).join(F.broadcast(whole))
    side = F.when(F.col("low") > F.col("pooled"), "above").when(F.col("high") < F.col("pooled"), "below").otherwise("overlaps")
    return out.select(key, "n", "k", (F.col("k") / F.col("n")).alias("share"), "low", "high", side.alias("vs_pooled"))


def without_top(df: DataFrame, key: str, most: int = 50) -> DataFrame:
    """Each group's unscreened rate as it is and without the globally largest implausible filings it holds."""
    groups = summarise(df, key).select(key, "hours_total", "cases_total", "aggregate_trir_unscreened", "aggregate_trir_screened")
    top = top_high(df, most).groupBy(key).agg(F.count("*").alias("top_n"), F.sum("total_hours_worked").alias("top_hours"), F.coalesce(F.sum("recordable_cases"), F.lit(0.0)).alias("top_cases"))
    out = groups.join(F.broadcast(top), key, "left").fillna(0, ["top_n"]).fillna(0.0, ["top_hours", "top_cases"])
    rest = ratio(PER_HOURS * (F.col("cases_total") - F.col("top_cases")), F.when(F.col("hours_total") > F.col("top_hours"), F.col("hours_total") - F.col("top_hours")))
    return out.select(key, "top_n", ratio(F.col("top_hours"), F.col("hours_total")).alias("top_hours_share"), F.col("aggregate_trir_unscreened").alias("trir_unscreened"), rest.alias("trir_unscreened_ex_top"), ratio(F.col("aggregate_trir_screened"), rest).alias("ratio_ex_top"))


def flag_counts(df: DataFrame, key: str) -> DataFrame:
    """key, n, k of each group."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").cast("double").alias("n"), F.count_if("implausible").cast("double").alias("k"))


def top_flagged(df: DataFrame, key: str, most: int = 3, least: int = 1000) -> DataFrame:
    """Groups of `least` filings or more that are among the first `most` by flag rate or by flagged hours, with both ranks (ties by key)."""
    hours = F.coalesce(F.sum(F.when(F.col("implausible"), F.col("total_hours_worked"))), F.lit(0.0))
    groups = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.count_if("implausible").alias("k"), hours.alias("h")).filter(F.col("n") >= least)
    rate = F.col("k") / F.col("n")
    by = lambda c: F.row_number().over(Window.orderBy(c.desc(), key)).cast("long")  # noqa: E731  a row for each group
    out = groups.select(key, "n", "k", rate.alias("flag_rate"), by(rate).alias("rank_by_rate"), by(F.col("h")).alias("rank_by_hours"))
    return out.filter((F.col("rank_by_rate") <= most) | (F.col("rank_by_hours") <= most))


def modal(df: DataFrame, key: str, value: str) -> DataFrame:
    """The most frequent value of each group, of several the least."""
    n = df.filter(F.col(value).isNotNull()).groupBy(key, value).count()
    return n.withColumn("p", F.row_number().over(Window.partitionBy(key).orderBy(F.col("count").desc(), value))).filter("p = 1").select(key, value)
