"""Grouped ratio-of-sums: summaries of the screen, prevalence of flags, rates, grids, concentration."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratewright.operators.derive import PER_HOURS, band_rank, size_band
from ratewright.operators.ranks import with_median
from ratewright.operators.screen import FLAGS, Bounds


#: Rates by name: the columns that their numerators add up.
RATES = {"trir": ("total_deaths", "total_dafw_cases", "total_djtr_cases", "total_other_cases"), "dart": ("total_dafw_cases", "total_djtr_cases"), "ltir": ("total_dafw_cases",), "severity": ("total_dafw_days", "total_djtr_days")}


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or missing."""
    return a / F.when(b != 0, b)


def pooled_rate(cases: Column, hours: Column) -> Column:
    """Cases per 200,000 hours of a whole group; null without hours."""
    return PER_HOURS * cases / F.when(hours > 0, hours)


def summary_columns() -> list[Column]:
    """The measures of a screened group, all from one pass."""
    bad, hours, cases = F.col("implausible"), F.col("total_hours_worked"), F.col("recordable_cases")
    zero = F.lit(0.0)
    h, c = F.coalesce(F.sum(hours), zero), F.coalesce(F.sum(cases), zero)
    hb, cb = F.coalesce(F.sum(F.when(bad, hours)), zero), F.coalesce(F.sum(F.when(bad, cases)), zero)
    good = ratio(PER_HOURS * F.sum(F.when(~bad, cases)), F.coalesce(F.sum(F.when(~bad, hours)), zero))
    return [
        F.count("*").alias("n_filings"), F.count_if(bad).alias("n_implausible"), F.avg(bad.cast("double")).alias("implausible_share"), h.alias("hours_total"), ratio(hb, h).alias("hours_share_implausible"),
        c.alias("cases_total"), ratio(cb, c).alias("cases_share_implausible"), ratio(PER_HOURS * c, h).alias("aggregate_trir_unscreened"), good.alias("aggregate_trir_screened"),
        ratio(good, ratio(PER_HOURS * c, h)).alias("ratio_screened_to_unscreened"),
    ]


def summarise(df: DataFrame, *by: str) -> DataFrame:
    """Summary of the screen, as a whole or by columns (rows with a null key are left out)."""
    for c in by:
        df = df.filter(F.col(c).isNotNull())
    out = df.groupBy(*by).agg(*summary_columns()) if by else df.agg(*summary_columns())
    return with_median(out, df.filter(~F.col("implausible")), by, "trir", "median_trir_screened")


def flag_prevalence(df: DataFrame) -> DataFrame:
    """flag, n, share, hours, hours_share: one aggregation of all flags, unfolded afterwards."""
    h = F.sum("total_hours_worked")
    one = df.agg(F.count("*").alias("all"), F.coalesce(h, F.lit(0.0)).alias("h"), *(F.count_if(f).alias(f"n_{f}") for f in FLAGS), *(F.coalesce(F.sum(F.when(F.col(f), F.col("total_hours_worked"))), F.lit(0.0)).alias(f"h_{f}") for f in FLAGS))
    rows = F.explode(F.array(*(F.struct(F.lit(f).alias("flag"), F.col(f"n_{f}").alias("n"), F.col(f"h_{f}").alias("hours")) for f in FLAGS)))
    return one.select("all", "h", rows.alias("r")).select("r.flag", "r.n", ratio(F.col("r.n").cast("double"), F.col("all")).alias("share"), "r.hours", ratio(F.col("r.hours"), F.col("h")).alias("hours_share"))


def sensitivity_grid(df: DataFrame, lows: tuple[float, ...] = (100, 120, 200, 300, 400), highs: tuple[float, ...] = (3500, 4000, 4500, 5000, 6000)) -> DataFrame:
    """The pooled summary under every pair of bounds, from one scan.

    The screen is monotone in each bound, so a filing's verdicts under all pairs follow from how many bounds its
    ratio lies beyond. Filings are added up by that place first; pairs meet only these few groups.
    """
    fixed = F.col("flag_hours_missing") | F.col("flag_employees_missing") | F.col("flag_negative_counts")
    r = F.col("hours_per_employee")
    below = reduce(lambda a, b: a + b, (F.coalesce(r < x, F.lit(False)).cast("int") for x in lows))
    above = reduce(lambda a, b: a + b, (F.coalesce(r > x, F.lit(False)).cast("int") for x in highs))
    places = df.groupBy(fixed.alias("fixed"), below.alias("below"), above.alias("above")).agg(F.count("*").alias("n"), F.coalesce(F.sum("total_hours_worked"), F.lit(0.0)).alias("h"), F.coalesce(F.sum("recordable_cases"), F.lit(0.0)).alias("c"))
    # a ratio below the i-th low (ascending) is below all later ones as well
    pairs = F.explode(F.array(*(F.struct(F.lit(float(lo)).alias("low"), F.lit(float(hi)).alias("high"), F.lit(sum(x >= lo for x in lows)).alias("need_below"), F.lit(sum(x <= hi for x in highs)).alias("need_above")) for lo in lows for hi in highs if hi > lo)))
    met = places.select("*", pairs.alias("p")).withColumn("bad", F.col("fixed") | (F.col("below") >= F.col("p.need_below")) | (F.col("above") >= F.col("p.need_above")))
    agg = met.groupBy("p.low", "p.high").agg(F.sum("n").alias("n_filings"), F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("n_implausible"), F.sum("h").alias("hours_total"), F.sum("c").alias("cases_total"), F.sum(F.when(F.col("bad"), F.col("h")).otherwise(0.0)).alias("flagged_hours"), F.sum(F.when(F.col("bad"), F.col("c")).otherwise(0.0)).alias("flagged_cases"))
    agg = agg.withColumns({"trir_unscreened": ratio(PER_HOURS * F.col("cases_total"), F.col("hours_total")), "trir_screened": ratio(PER_HOURS * (F.col("cases_total") - F.col("flagged_cases")), F.col("hours_total") - F.col("flagged_hours")), "implausible_share": ratio(F.col("n_implausible").cast("double"), F.col("n_filings"))})
    return agg.withColumn("label", F.concat(F.col("low").cast("int").cast("string"), F.lit("-"), F.col("high").cast("int").cast("string"))).withColumn("ratio_screened_to_unscreened", ratio(F.col("trir_screened"), F.col("trir_unscreened")))


def threshold_cells(grid: DataFrame, bounds: Bounds = Bounds()) -> DataFrame:
    """Grid cells against the default cell, and their rank by screened rate (ties by label)."""
    base = grid.filter((F.col("low") == bounds.low) & (F.col("high") == bounds.high)).select(F.col("trir_screened").alias("d_trir"), F.col("implausible_share").alias("d_share"))
    rank = F.row_number().over(Window.orderBy(F.round("trir_screened", 9).desc(), "low", "high"))  # one row for each pair of bounds
    out = grid.join(F.broadcast(base))
    return out.select("label", "low", "high", "n_implausible", "flagged_hours", "flagged_cases", (F.col("hours_total") - F.col("flagged_hours")).alias("screened_hours"), (F.col("cases_total") - F.col("flagged_cases")).alias("screened_cases"), (F.col("trir_screened") - F.col("d_trir")).alias("trir_minus_default"), (100 * (F.col("trir_screened") / F.col("d_trir") - 1)).alias("trir_pct_from_default"), (F.col("implausible_share") / F.col("d_share")).alias("share_over_default"), rank.cast("long").alias("trir_rank"))


def marginal_bands(grid: DataFrame, bounds: Bounds = Bounds()) -> DataFrame:
    """What each step of one bound adds to the flagged filings while the other stays at its default: flagged sets are nested."""
    low_steps = grid.filter(F.col("high") == bounds.high).select(F.lit("low").alias("bound"), F.col("low").alias("value"), "n_implausible", "flagged_hours", "flagged_cases")
    high_steps = grid.filter(F.col("low") == bounds.low).select(F.lit("high").alias("bound"), F.col("high").alias("value"), "n_implausible", "flagged_hours", "flagged_cases")
    before = Window.partitionBy("bound").orderBy("value")
    out = low_steps.unionByName(high_steps)
    step = lambda c: F.abs(F.col(c) - F.lag(c).over(before))
    out = out.select("bound", F.lag("value").over(before).alias("value_from"), F.col("value").alias("value_to"), step("n_implausible").alias("filings"), step("flagged_hours").alias("hours"), step("flagged_cases").alias("cases")).filter("value_from is not null")
    return out.withColumn("trir", ratio(PER_HOURS * F.col("cases"), F.col("hours")))


def top_by_hours(df: DataFrame, most: int) -> DataFrame:
    """The `most` filings of largest hours with their rank; ties by id. Sorted and cut per partition before they meet."""
    top = df.filter("total_hours_worked is not null").orderBy(F.col("total_hours_worked").desc(), "id").limit(most)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("total_hours_worked").desc(), "id")))


def hours_concentration(df: DataFrame, tops: tuple[int, ...] = (1, 10, 100, 1000, 10000)) -> DataFrame:
    """top_n, hours_share, cases_share: what the filings of largest hours hold of all hours and cases."""
    total = df.agg(F.coalesce(F.sum("total_hours_worked"), F.lit(0.0)).alias("h"), F.coalesce(F.sum("recordable_cases"), F.lit(0.0)).alias("c"))
    top = top_by_hours(df.select("id", "total_hours_worked", "recordable_cases"), max(tops))
    held = top.agg(*(x for n in tops for x in (F.sum(F.when(F.col("rank") <= n, F.col("total_hours_worked"))).alias(f"h{n}"), F.sum(F.when(F.col("rank") <= n, F.col("recordable_cases"))).alias(f"c{n}"))))
    rows = F.explode(F.array(*(F.struct(F.lit(n).cast("long").alias("top_n"), F.col(f"h{n}").alias("hh"), F.col(f"c{n}").alias("cc")) for n in tops)))
    return held.join(F.broadcast(total)).select("h", "c", rows.alias("r")).select("r.top_n", ratio(F.col("r.hh"), F.col("h")).alias("hours_share"), ratio(F.coalesce("r.cc", F.lit(0.0)), F.col("c")).alias("cases_share"))


def rank_trim(df: DataFrame, tops: tuple[int, ...] = (1, 10, 100, 1000, 10000)) -> DataFrame:
    """The rate of all filings without the top n by hours: a check that needs no bounds; null if no hours are left."""
    hours, cases, at = F.col("total_hours_worked"), F.col("recordable_cases"), F.struct(-F.col("total_hours_worked"), F.col("id"))
    top = top_by_hours(df.select("id", "total_hours_worked", "recordable_cases"), max(tops))
    ends = top.agg(*(F.max(F.when(F.col("rank") == n, at)).alias(f"e{n}") for n in tops))  # the last one of each top; null if there are fewer
    # sums of what is left, not differences: no digits are lost where the top holds nearly everything
    beyond = {n: F.coalesce(at > F.col(f"e{n}"), F.lit(False)) for n in tops}
    left = df.join(F.broadcast(ends)).agg(F.count("*").alias("n"), F.count(cases).alias("counted"), *(x for n in tops for x in (F.sum(F.when(beyond[n] & hours.isNotNull(), hours)).alias(f"h{n}"), F.sum(F.when(beyond[n] | hours.isNull(), cases)).alias(f"c{n}"))))
    rows = F.explode(F.array(*(F.struct(F.lit(n).cast("long").alias("top_n"), F.col(f"h{n}").alias("h"), F.when(F.col("counted") > 0, F.coalesce(f"c{n}", F.lit(0.0))).alias("c")) for n in tops)))
    return left.select("n", rows.alias("r")).select("r.top_n", ratio(PER_HOURS * F.col("r.c"), F.when(F.col("r.h") > 0, F.col("r.h"))).alias("trir"), (F.col("r.top_n") / F.col("n")).alias("share_of_filings"))


def rates(df: DataFrame, *by: str) -> DataFrame:
    """The four rates, unscreened and screened, with their numerators: a part that is missing counts as 0 here."""
    hours, good = F.col("total_hours_worked"), ~F.col("implausible")
    columns = [F.count("*").alias("n_filings"), F.count_if(good).alias("n_screened"), F.coalesce(F.sum(hours), F.lit(0.0)).alias("hours_unscreened"), F.coalesce(F.sum(F.when(good, hours)), F.lit(0.0)).alias("hours_screened")]
    for name, parts in RATES.items():
        top = reduce(lambda a, b: a + b, (F.coalesce(F.col(p), F.lit(0.0)) for p in parts))
        columns += [F.sum(top).alias(f"{name}_numerator"), F.coalesce(F.sum(F.when(good, top)), F.lit(0.0)).alias(f"{name}_numerator_screened")]
    out = (df.groupBy(*by) if by else df.groupBy()).agg(*columns)
    for name in RATES:
        raw, kept = pooled_rate(F.col(f"{name}_numerator"), F.col("hours_unscreened")), pooled_rate(F.col(f"{name}_numerator_screened"), F.col("hours_screened"))
        out = out.withColumns({f"{name}_unscreened": raw, f"{name}_screened": kept, f"{name}_ratio": ratio(kept, raw)})
    return out


def zero_share(df: DataFrame, *by: str) -> DataFrame:
    """Share of plausible filings without cases (missing counts are not zero), with the number of filings."""
    good = df.filter(~F.col("implausible"))
    return (good.groupBy(*by) if by else good.groupBy()).agg(F.count("*").alias("n"), F.avg(F.when(F.col("recordable_cases") == 0, 1.0).otherwise(0.0)).alias("zero_share"))


def size_effects(df: DataFrame) -> DataFrame:
    """By size band of plausible filings: zero share, mean, population variance, their ratio, rate, median; and the band's rank."""
    good = df.filter(~F.col("implausible")).withColumn("size_band", size_band(F.col("annual_average_employees"))).filter("size_band is not null")
    cases = F.col("recordable_cases")
    out = good.groupBy("size_band").agg(
        F.count("*").alias("n"), F.avg(F.when(cases == 0, 1.0).otherwise(0.0)).alias("zero_share"), F.avg(cases).alias("mean_cases"), F.var_pop(cases).alias("var_cases"),
        pooled_rate(F.sum(cases), F.sum("total_hours_worked")).alias("aggregate_trir"),
    )
    out = with_median(out, good, ["size_band"], "trir", "median_trir")
    return out.withColumns({"variance_to_mean": ratio(F.col("var_cases"), F.col("mean_cases")), "band_rank": band_rank(F.col("size_band")).cast("long")})


def case_histogram(df: DataFrame, most: int = 10) -> DataFrame:
    """How many plausible filings have 0, 1, ... cases; `most` and more together."""
    k = F.least(F.col("recordable_cases"), F.lit(float(most))).cast("long")
    out = df.filter(~F.col("implausible") & F.col("recordable_cases").isNotNull()).groupBy(k.alias("sort_key")).agg(F.count("*").alias("n"))
    return out.select(F.when(F.col("sort_key") >= most, F.lit(f"{most}+")).otherwise(F.col("sort_key").cast("string")).alias("count"), "sort_key", "n")


def hours_histogram(df: DataFrame) -> DataFrame:
    """Filings by tenths of log10 of hours per employee, clipped to 0.1 and 10^8: 90 bins."""
    log = F.log10(F.greatest(F.lit(0.1), F.least(F.col("hours_per_employee"), F.lit(1e8))))
    return df.filter("hours_per_employee > 0").groupBy(F.least(F.floor((log + 1) * 10), F.lit(89)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def reconcile_panels(df: DataFrame, old_years: tuple[int, ...], old: Bounds = Bounds(100, 4000), new: Bounds = Bounds(), lows: tuple[float, ...] = (100, 120), highs: tuple[float, ...] = (4000, 4500)) -> DataFrame:
    """The pooled summary under an older panel (years and bounds), this one, and the older years under several bounds.

    Each filing is unfolded into the definitions it belongs to, so one scan and one aggregation serve all of them.
    """
    panels = [("old", "old", old, old_years), ("new", "new", new, None)] + [("old_years_sensitivity", f"old_years_{lo:g}-{hi:g}", Bounds(lo, hi), old_years) for lo in lows for hi in highs if hi > lo]
    fixed = F.col("flag_hours_missing") | F.col("flag_employees_missing") | F.col("flag_negative_counts")
    r = F.coalesce("hours_per_employee", F.lit(float(new.low)))
    entries = [F.when(F.col("year_filing_for").isin(*years) if years else F.lit(True), F.struct(F.lit(p).alias("panel"), F.lit(label).alias("label"), (fixed | (r < b.low) | (r > b.high)).alias("bad"))) for p, label, b, years in panels]
    rows = df.select("year_filing_for", "total_hours_worked", "recordable_cases", "trir", F.explode(F.array_compact(F.array(*entries))).alias("e")).select("year_filing_for", "total_hours_worked", "recordable_cases", "trir", "e.panel", "e.label", F.col("e.bad").alias("implausible"))
    out = rows.groupBy("panel", "label").agg(*summary_columns(), F.min("year_filing_for").alias("year_first"), F.max("year_filing_for").alias("year_last"))
    return with_median(out, rows.filter(~F.col("implausible")), ["panel", "label"], "trir", "median_trir_screened")
