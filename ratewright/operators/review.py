"""Review of a two-year table: screen, single-row influence, rows set aside, and reviews that are bound to their source."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratewright.operators.derive import PER_HOURS
from ratewright.operators.rates import pooled_rate
from ratewright.operators.without import sums_without
from ratewright.shared import cut
from ratewright.sources.loader import UploadError


def analyse(rows: DataFrame, years: tuple[int, int] | None = None, low: float = 120, high: float = 4500, excluded: tuple[str, ...] = ()) -> DataFrame:
    """Each row of the two years: whether it passes, is set aside, its year's rate without it, its rank, and whether that turns the trend.

    rows: year, employees, hours, cases, filing_id. The last two years are taken if none are named. Keys are
    year:filing_id. Rates without a row are sums of the rows on its two sides, so a dominant row can't cancel.
    """
    if not 0 <= low < high < float("inf"):
        raise UploadError("bad_screen", "bounds must satisfy 0 <= low < high")
    there = sorted(r[0] for r in rows.filter("year is not null").select("year").distinct().collect())
    chosen = sorted(years) if years else there[-2:]
    if len(chosen) != 2 or chosen[0] == chosen[1] or not set(chosen) <= set(there):
        raise UploadError("bad_years", "two different years of the table are needed")
    keyed = rows.withColumn("key", F.concat_ws(":", "year", "filing_id"))
    keys = keyed.groupBy("key").agg(F.count("*").alias("n"))
    found = keys.agg(F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(F.col("key").isin(*excluded) if excluded else F.lit(False)).alias("named")).first()
    if found.repeated:
        raise UploadError("repeated_key", "row keys are not unique")
    if found.named != len(set(excluded)):
        raise UploadError("unknown_key", "a row that is set aside isn't in the table")
    ratio = F.col("hours") / F.when(F.col("employees") > 0, F.col("employees"))
    passes = F.coalesce((ratio >= low) & (ratio <= high), F.lit(False))
    df = keyed.filter(F.col("year").isin(*chosen)).withColumns({"hours_per_employee": ratio, "passes": passes, "excluded": passes & F.col("key").isin(*excluded) if excluded else F.lit(False)})
    good = df.filter("passes")
    summed = sums_without(good, "year", "key", ("hours", "cases"))
    loo = summed.withColumns({"rate": pooled_rate(F.col("all_cases"), F.col("all_hours")), "rate_without": pooled_rate(F.col("without_cases"), F.col("without_hours")), "hours_share": F.col("hours") / F.col("all_hours")})
    base = good.groupBy("year").agg(pooled_rate(F.sum("cases"), F.sum("hours")).alias("r"))
    both = base.agg(F.max(F.when(F.col("year") == chosen[0], F.col("r"))).alias("r0"), F.max(F.when(F.col("year") == chosen[1], F.col("r"))).alias("r1"))
    first = F.col("year") == chosen[0]
    change = F.when(first, F.col("r1") - F.col("rate_without")).otherwise(F.col("rate_without") - F.col("r0"))
    scored = loo.join(F.broadcast(both)).withColumns({"change": F.col("rate_without") - F.col("rate"), "trend_without": change, "reverses": F.coalesce(change * (F.col("r1") - F.col("r0")) < 0, F.lit(False))})
    scored = ranked(scored)
    return df.join(scored.select("key", "rate", "rate_without", "hours_share", "change", "trend_without", "rank", "reverses"), "key", "left")


def ranked(scored: DataFrame) -> DataFrame:
    """`scored` with the rank of each row in its year by how far the rate moves without it (ties by key; unknown moves last).

    Rows are dealt into parts by ranges of the move and the key, ranked in their part, and moved on by the rows of the parts before: no
    task sorts a year.
    """
    move = F.coalesce(F.abs("change"), F.lit(-1.0))
    dealt = cut(scored.withColumn("__move", move).repartitionByRange(F.col("year"), F.col("__move").desc(), F.col("key")).withColumn("__part", F.spark_partition_id()), "ranked")
    sizes = dealt.groupBy("year", "__part").agg(F.count("*").alias("__n"))
    before = sizes.select("year", "__part", F.coalesce(F.sum("__n").over(Window.partitionBy("year").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("year", "__part").orderBy(F.col("__move").desc(), "key"))
    return dealt.withColumn("__own", own).join(before, ["year", "__part"]).withColumn("rank", (F.col("__own") + F.col("__before")).cast("long"))


def annual(analysed: DataFrame) -> DataFrame:
    """Each year's rows, what the screen and the reviewer took out, and the rate before and after the review."""
    kept = F.col("passes") & ~F.col("excluded")
    rate = lambda c: pooled_rate(F.sum(F.when(c, F.col("cases"))), F.sum(F.when(c, F.col("hours"))))
    return analysed.groupBy("year").agg(F.count("*").alias("n"), F.count_if("passes").alias("accepted"), F.count_if(~F.col("passes")).alias("rejected"), F.count_if("excluded").alias("excluded"), rate(F.col("passes")).alias("rate"), rate(kept).alias("review_rate"))


def source_hash(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def save_review(sha256: str, years: tuple[int, int], low: float, high: float, excluded: tuple[str, ...], note: str = "") -> str:
    return json.dumps({"version": 1, "source": {"sha256": sha256}, "years": sorted(years), "screen": {"low": low, "high": high}, "excluded": sorted(excluded), "note": note}, sort_keys=True)


def restore_review(rows: DataFrame, sha256: str, text: str) -> tuple[DataFrame, str]:
    """(the analysis under a review's inputs, its note). Results are computed anew; a review of another source is refused."""
    try:
        review = json.loads(text)
        years, screen, excluded, note = review["years"], review["screen"], review["excluded"], review["note"]
        ok = review["version"] == 1 and len(years) == 2 and years[0] < years[1] and len(set(excluded)) == len(excluded) and all(isinstance(k, str) for k in excluded) and isinstance(note, str) and len(note) <= 4000
    except (ValueError, KeyError, TypeError) as e:
        raise UploadError("bad_review", "this is no review") from e
    if not ok:
        raise UploadError("bad_review", "this is no review")
    if review["source"].get("sha256") != sha256:
        raise UploadError("other_source", "the review belongs to another file")
    out = analyse(rows, tuple(years), screen["low"], screen["high"], tuple(excluded))
    if out.filter("excluded").count() != len(excluded):
        raise UploadError("bad_review", "a row that is set aside doesn't pass the screen of the review's years")
    return out, note


def scaled(hours: Column, employees: Column, cases: Column, total_cases: Column, total_hours: Column, factor: float) -> dict[str, Column]:
    """What scaling one row's hours and employees alike does: its ratio stays, its rate and the pool's fall."""
    if not factor >= 1:
        raise ValueError("the factor must be at least 1")
    more = total_hours + (factor - 1) * hours
    return {"hours_per_employee": hours * factor / F.when(employees > 0, employees * factor), "row_rate": PER_HOURS * cases / F.when(hours > 0, hours * factor), "pool_rate": PER_HOURS * total_cases / F.when(more > 0, more)}


def scenario_rows(analysed: DataFrame) -> DataFrame:
    """scenario, year_from, year_to, rate_from, rate_to, change, change_pct: the two years as loaded, as screened, as reviewed, and
    without the row whose removal moves each year most. A rate without hours is null, as is a change from 0 in percent."""
    cases = {"loaded": F.lit(True), "screened": F.col("passes"), "reviewed": F.col("passes") & ~F.col("excluded"), "without_most_influential": F.col("passes") & (F.col("rank") > 1)}
    per = analysed.groupBy("year").agg(*(pooled_rate(F.sum(F.when(c, F.col("cases"))), F.sum(F.when(c, F.col("hours")))).alias(k) for k, c in cases.items()))
    both = per.agg(F.min("year").alias("year_from"), F.max("year").alias("year_to"), *(f(k, "year").alias(f"{k}_{e}") for k in cases for f, e in ((F.min_by, "from"), (F.max_by, "to"))))
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("scenario"), F.col(f"{k}_from").alias("rate_from"), F.col(f"{k}_to").alias("rate_to")) for k in cases)))
    return both.select("year_from", "year_to", rows.alias("s")).select("s.scenario", "year_from", "year_to", "s.rate_from", "s.rate_to", (F.col("s.rate_to") - F.col("s.rate_from")).alias("change"), (100 * (F.col("s.rate_to") / F.when(F.col("s.rate_from") != 0, F.col("s.rate_from")) - 1)).alias("change_pct"))
