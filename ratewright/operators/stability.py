"""How benchmarks hold from year to year: rank correlation, persistence of groups, pools without a year, forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratewright.operators.derive import PER_HOURS
from ratewright.operators.peers import PERCENTILES
from ratewright.operators.rates import ratio

KEYS = ("naics3", "size_band")


def average_rank(value: str, *by: str) -> Column:
    """Rank from 1 by ascending value; equal values share the mean of their places."""
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2


def spearman(a: str, b: str, least: int = 3) -> Column:
    """Correlation of two columns of ranks; null below `least` pairs, or if either is constant."""
    flat = (F.var_pop(a) == 0) | (F.var_pop(b) == 0) | (F.count("*") < least)
    top = F.covar_pop(a, b)
    return F.when(~flat, top / F.when(~flat, F.stddev_pop(a) * F.stddev_pop(b)))


def year_pairs(table: DataFrame) -> DataFrame:
    """Each year of a table with the next one there is: (year_from, year_to)."""
    years = table.select(F.col("year_filing_for").alias("year_from")).distinct()
    return years.withColumn("year_to", F.lead("year_from").over(Window.orderBy("year_from"))).filter("year_to is not null")  # a row a year


def matched(table: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Rows of a group in one year beside its row in the next, as structs a and b."""
    pairs = F.broadcast(year_pairs(table))
    row = F.struct(*(c for c in table.columns if c not in (*keys, "year_filing_for")))
    a = table.join(pairs, F.col("year_filing_for") == F.col("year_from")).select("year_from", "year_to", *keys, row.alias("a"))
    b = table.select(F.col("year_filing_for").alias("year_to"), *keys, row.alias("b"))
    return a.join(b, ["year_to", *keys])


def band_stability(table: DataFrame) -> DataFrame:
    """For each pair of years and percentile of publishable groups: matched groups, rank correlation, median changes."""
    both = matched(table.filter("publishable"))
    long = both.select("year_from", "year_to", F.explode(F.array(*(F.struct(F.lit(p).alias("percentile"), F.col(f"a.{p}").alias("v0"), F.col(f"b.{p}").alias("v1")) for p in PERCENTILES))).alias("x")).select("year_from", "year_to", "x.*").filter("v0 is not null and v1 is not null")
    by = ("year_from", "year_to", "percentile")
    ranked = long.withColumns({"r0": average_rank("v0", *by), "r1": average_rank("v1", *by)})
    change = F.abs(F.col("v1") - F.col("v0"))
    out = ranked.groupBy(*by).agg(F.count("*").alias("n_matched_groups"), spearman("r0", "r1").alias("spearman_rho"), F.percentile(change, F.lit(0.5)).alias("median_abs_change"), F.percentile(F.when(F.col("v0") > 0, change / F.when(F.col("v0") > 0, F.col("v0"))), F.lit(0.5)).alias("median_abs_rel_change"))
    return out.filter("n_matched_groups >= 3")


def stability_summary(table: DataFrame) -> DataFrame:
    """Medians over year pairs, by percentile."""
    return band_stability(table).groupBy("percentile").agg(F.percentile("spearman_rho", F.lit(0.5)).alias("median_rho"), F.percentile("median_abs_rel_change", F.lit(0.5)).alias("median_abs_rel_change"))


def group_persistence(table: DataFrame) -> DataFrame:
    """For each pair of years: publishable groups in either, in both, and what share of the first stays."""
    ok = table.filter("publishable").select("year_filing_for", *KEYS)
    pairs = F.broadcast(year_pairs(ok))
    here = ok.join(pairs, F.col("year_filing_for") == F.col("year_from")).select("year_from", "year_to", *KEYS, F.lit(1).alias("x"), F.lit(0).alias("y"))
    there = ok.join(pairs, F.col("year_filing_for") == F.col("year_to")).select("year_from", "year_to", *KEYS, F.lit(0).alias("x"), F.lit(1).alias("y"))
    both = here.unionByName(there).groupBy("year_from", "year_to", *KEYS).agg(F.max("x").alias("x"), F.max("y").alias("y"))
    out = both.groupBy("year_from", "year_to").agg(F.sum("x").alias("groups_year_from"), F.sum("y").alias("groups_year_to"), F.sum(F.col("x") * F.col("y")).alias("groups_matched"))
    return out.withColumn("matched_share_of_year_from", ratio(F.col("groups_matched").cast("double"), F.col("groups_year_from")))


def year_totals(df: DataFrame) -> DataFrame:
    """The sums of each year that any pool of years follows from."""
    good = ~F.col("implausible")
    part = lambda c: F.coalesce(F.sum(F.when(good, F.col(c))), F.lit(0.0))
    return df.groupBy(F.col("year_filing_for").alias("year")).agg(F.count("*").alias("n"), F.count_if(~good).alias("k"), F.coalesce(F.sum("total_hours_worked"), F.lit(0.0)).alias("h"), F.coalesce(F.sum("recordable_cases"), F.lit(0.0)).alias("c"), part("total_hours_worked").alias("gh"), part("recordable_cases").alias("gc"))


def pool(n: Column, k: Column, h: Column, c: Column, gh: Column, gc: Column) -> dict[str, Column]:
    raw, kept = ratio(PER_HOURS * c, h), ratio(PER_HOURS * gc, gh)
    return {"n_filings": n, "n_implausible": k, "implausible_share": ratio(k.cast("double"), n), "hours_share_implausible": 1 - ratio(gh, h), "trir_unscreened": raw, "trir_screened": kept, "ratio_screened_to_unscreened": ratio(kept, raw)}


def leave_one_year_out(df: DataFrame) -> DataFrame:
    """The pool of all years, and each pool without one year with its distance to that."""
    t = year_totals(df)
    whole = t.agg(*(F.sum(c).alias(f"t{c}") for c in ("n", "k", "h", "c", "gh", "gc")))
    rows = t.select(F.col("year").cast("string").alias("left_out_year"), "n", "k", "h", "c", "gh", "gc").unionByName(t.limit(0).select(F.lit("").alias("left_out_year"), "n", "k", "h", "c", "gh", "gc")).join(F.broadcast(whole))
    rest = rows.select("left_out_year", *((F.col(f"t{c}") - F.col(c)).alias(c) for c in ("n", "k", "h", "c", "gh", "gc")), *(f"t{c}" for c in ("n", "k", "h", "c", "gh", "gc")))
    every = whole.select(F.lit("all").alias("left_out_year"), *(F.col(f"t{c}").alias(c) for c in ("n", "k", "h", "c", "gh", "gc")), *whole.columns)
    both = every.unionByName(rest)
    names = ("n", "k", "h", "c", "gh", "gc")
    own, ref = pool(*map(F.col, names)), pool(*(F.col(f"t{c}") for c in names))
    return both.select("left_out_year", *(v.alias(k) for k, v in own.items()), (own["implausible_share"] - ref["implausible_share"]).alias("implausible_share_minus_pooled"), (100 * (own["trir_screened"] / ref["trir_screened"] - 1)).alias("trir_screened_pct_from_pooled"))


def year_over_year(df: DataFrame) -> DataFrame:
    """Each year's pool with its change from the year before; one row for each year is ordered."""
    t = year_totals(df)
    out = t.select("year", *(v.alias(k) for k, v in pool(*(F.col(c) for c in ("n", "k", "h", "c", "gh", "gc"))).items()))
    before = Window.orderBy("year")
    last = F.lag("trir_screened").over(before)
    return out.withColumns({"implausible_share_change": F.col("implausible_share") - F.lag("implausible_share").over(before), "trir_screened_change": F.col("trir_screened") - last, "trir_screened_pct_change": 100 * (F.col("trir_screened") / F.when(last != 0, last) - 1)})


TRANSFORMS = {"identity": (lambda c: c, lambda c: c), "log": (F.log, F.exp), "logit": (lambda c: F.log(c / (1 - c)), lambda c: 1 / (1 + F.exp(-c)))}


def rolling_forecast(series: DataFrame, by: str, time: str, value: str, back: int = 3, width: float = 2.4469, transform: str = "identity") -> DataFrame:
    """For each series a forecast of the next time: the mean of its last `back` values, and an interval from how far such means missed.

    Works on a transformed scale and returns to the original one; null interval without a test of the method.
    """
    to, fro = TRANSFORMS[transform]
    own = Window.partitionBy(by).orderBy(time)
    window = own.rowsBetween(-back, -1)
    rows = series.withColumn("x", to(F.col(value))).withColumns({"past": F.avg("x").over(window), "seen": F.count("x").over(window)})
    rows = rows.withColumn("miss", F.when(F.col("seen") == back, F.col("x") - F.col("past")))
    last = rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.col(time).desc())))
    out = last.groupBy(by).agg(F.max(time).alias("last_time"), F.avg(F.when(F.col("place") <= back, F.col("x"))).alias("mid"), F.sqrt(F.avg(F.col("miss") * F.col("miss"))).alias("rmse"), F.count("miss").alias("n_tested"))
    return out.select(by, "last_time", fro(F.col("mid")).alias("forecast"), fro(F.col("mid") - width * F.col("rmse")).alias("low"), fro(F.col("mid") + width * F.col("rmse")).alias("high"), "n_tested")
