"""What counts of cases can show: cases for a precise rate, hours to tell two rates apart, both by size band.

Searches are rows: every count or number of hours that is tried is a row, tried in blocks until all groups have theirs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratewright.functions import exact
from ratewright.operators.derive import PER_HOURS
from ratewright.operators.rates import ratio, size_effects
from ratewright.shared import cut

#: Rounded quantiles of the normal law at 97.5 and 80 %; only where the search of hours begins depends on them.
BEGIN = 1.959964 + 0.841621

#: Rate ratios of the table by band; the ratio of an interval's ends that counts as precise.
RATIOS, PRECISE = (1.25, 1.5, 2.0), 2.0

#: Rows that are tried at once for each group.
BLOCK = 128


def searched(groups: DataFrame, tried: Column, test: Column, keep: list[Column]) -> DataFrame:
    """`groups` with, for each row, the first number i = 0, 1, .. for which `test` holds, and columns worked out there.

    tried: array of the numbers of a block, from column __block. Goes on with the groups that have none, block by block.
    """
    groups = cut(groups, "groups")  # sums of doubles may come out otherwise when they are worked out again, and rows are matched by them
    found, open_, block = [], groups, 0
    while not open_.isEmpty():
        rows = open_.withColumn("__block", F.lit(block)).withColumn("i", F.explode(tried))
        hit = rows.withColumn("__ok", test).filter("__ok").select(*groups.columns, "i", *keep)
        first = hit.withColumn("__place", F.row_number().over(Window.partitionBy(*groups.columns).orderBy("i"))).filter("__place = 1").drop("__place")
        found.append(cut(first, "searched"))
        open_ = cut(open_.join(found[-1].select(*groups.columns), groups.columns, "left_anti"), "open")
        block += 1
    if not found:
        return groups.select("*", F.lit(0).cast("long").alias("i"), *keep).filter("false")
    return reduce(lambda a, b: a.unionByName(b), found)


def cases_for_precision(groups: DataFrame, most: str = "ratio", level: float = 0.95) -> DataFrame:
    """Distinct rows of `groups` with `cases`: the least count, 1 or more, whose exact interval ends are at most a column `most`
    apart as a ratio. Rows without a ratio above 1 are left out, as no count is that precise."""
    use = groups.filter(F.col(most) > 1).distinct()
    tried = F.sequence(F.col("__block").cast("long") * BLOCK + 1, (F.col("__block").cast("long") + 1) * BLOCK)
    ends = exact.poisson_interval(F.col("i"), level)
    return searched(use, tried, ends["high"] <= F.col(most) * ends["low"], []).withColumnRenamed("i", "cases")


def hours_for_power(groups: DataFrame, target: float = 0.8, level: float = 0.05, step: float = 1.01) -> DataFrame:
    """Distinct rows of `groups` (with rate_1 and rate_2) with rung, hours and power: the first hours of a ladder by `step` that reach
    the power `target`. Power isn't monotone in hours, as counts are whole: the first rung counts, none is skipped. The ladder
    begins at half of what the normal law asks for. Rows without two different rates above 0 are left out."""
    one, two = F.col("rate_1"), F.col("rate_2")
    use = groups.filter((one > 0) & (two > 0) & (one != two)).distinct()
    begin = F.greatest(F.lit(1.0), F.lit(0.5 * BEGIN * BEGIN * PER_HOURS) * (one + two) / ((one - two) * (one - two)))
    hours = begin * F.pow(F.lit(step), F.col("i").cast("double"))
    tried = F.sequence(F.col("__block").cast("long") * BLOCK, (F.col("__block").cast("long") + 1) * BLOCK - 1)
    power = exact.power(one * hours / PER_HOURS, two * hours / PER_HOURS, level)
    return searched(use, tried, power >= target, [hours.alias("hours"), power.alias("power")]).withColumnRenamed("i", "rung")


def band_rates(df: DataFrame) -> DataFrame:
    """size_band, n_filings, rate, mean_cases, mean_hours (what the mean cases stand for at that rate) of bands with cases."""
    bands = size_effects(df).filter("aggregate_trir > 0")
    return bands.select("size_band", F.col("n").alias("n_filings"), F.col("aggregate_trir").alias("rate"), "mean_cases", (PER_HOURS * F.col("mean_cases") / F.col("aggregate_trir")).alias("mean_hours"))


def precision_by_band(bands: DataFrame, ratios: tuple[float, ...] = (PRECISE,)) -> DataFrame:
    """For each band and ratio of an interval's ends: cases, and the hours and filings of mean size that they take at the band's rate."""
    spark = bands.sparkSession
    cases = cases_for_precision(spark.createDataFrame([(float(r),) for r in ratios], "ratio double"))
    out = bands.join(F.broadcast(cases))  # a row for each ratio asked for
    hours = F.col("cases") * PER_HOURS / F.col("rate")
    return out.select("size_band", "ratio", "cases", hours.alias("hours"), ratio(hours, F.col("mean_hours")).alias("site_years"))


def power_by_band(bands: DataFrame, ratios: tuple[float, ...] = RATIOS, target: float = 0.8) -> DataFrame:
    """For each band and ratio of rates: the hours in each period that tell them apart, and the power of one filing of mean size in each."""
    # written once: rates meet by equality below, and a sum of doubles that is worked out again may differ in its last bits
    each = cut(bands.select("size_band", "rate", "mean_hours", F.explode(F.array(*(F.lit(float(r)) for r in ratios))).alias("ratio")), "each")
    found = hours_for_power(each.select(F.col("rate").alias("rate_1"), (F.col("rate") * F.col("ratio")).alias("rate_2")), target)
    met = each.join(found, (F.col("rate") == F.col("rate_1")) & (F.col("rate") * F.col("ratio") == F.col("rate_2")))
    m = F.col("rate") * F.col("mean_hours") / PER_HOURS
    return met.select("size_band", "ratio", "rung", "hours", "power", ratio(F.col("hours"), F.col("mean_hours")).alias("site_years"), exact.power(m, m * F.col("ratio")).alias("power_of_one"))


def detectability(df: DataFrame, ratios: tuple[float, ...] = RATIOS, precise: float = PRECISE) -> DataFrame:
    """One row for each size band of screened filings: its rate, the upper bound that a filing of mean size without cases allows,
    cases, hours and filings for a precise rate, and for each ratio of rates the power of one filing and the filings needed."""
    bands = cut(band_rates(df), "bands")
    tag = lambda r: f"{r:g}".replace(".", "_")
    wide = power_by_band(bands, ratios).groupBy("size_band").agg(*(F.max(F.when(F.col("ratio") == r, F.col(c))).alias(f"{c}_{tag(r)}") for r in ratios for c in ("power_of_one", "site_years")))
    none = exact.poisson_interval(F.lit(0))["high"]
    out = bands.withColumn("upper_without_cases", PER_HOURS * none / F.col("mean_hours"))
    precision = precision_by_band(bands, (precise,)).drop("ratio").withColumnsRenamed({"cases": "cases_precise", "hours": "hours_precise", "site_years": "site_years_precise"})
    return out.join(precision, "size_band").join(wide, "size_band")


def gini_bootstrap(groups: DataFrame, part: str, whole: str, tie: str, draws: int = 2000, seed: int = 1) -> DataFrame:
    """gini, low, high, draws: the concentration of `part` over `whole` by groups, and the middle 95 % of redraws.

    Each redraw takes for every group a binomial count of its own trials and share; draws are rows, and their random numbers
    digests of seed, draw and group, so reruns agree. A redraw without any hit has a Gini of 1 minus the area under a flat line: 1. Groups are
    few (sectors); draws x groups rows are spread over all tasks.
    """
    base = groups.filter(F.col(whole) > 0).select(F.col(tie).alias("g"), F.col(part).cast("double").alias("k"), F.col(whole).cast("double").alias("n"))
    rows = base.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws)))).repartition("draw")
    drawn = exact.binomial_draw(F.col("n"), F.col("k"), exact.even_number(F.lit(seed), F.col("draw"), F.col("g")))
    rows = rows.withColumn("k", F.when(F.col("draw") == 0, F.col("k")).otherwise(drawn.cast("double")))  # draw 0: as seen
    order, every = Window.partitionBy("draw").orderBy(F.col("k") / F.col("n"), "g"), Window.partitionBy("draw")
    upto = lambda c, end: F.coalesce(F.sum(c).over(order.rowsBetween(Window.unboundedPreceding, end)), F.lit(0.0))
    share = lambda c, end: upto(c, end) / F.greatest(F.sum(c).over(every), F.lit(1.0))
    area = (share("n", 0) - share("n", -1)) * (share("k", 0) + share("k", -1))
    gini = cut(rows.select("draw", area.alias("a")).groupBy("draw").agg((1 - F.sum("a")).alias("gini")), "draws")
    from ratewright.operators.ranks import percentiles

    ends = percentiles(gini.filter("draw > 0"), [], "gini", [0.025, 0.975])
    seen = gini.filter("draw = 0").select("gini")
    return seen.join(ends).select("gini", F.get("cuts", F.lit(0)).alias("low"), F.get("cuts", F.lit(1)).alias("high"), F.col("n_values").alias("draws"))
