"""What single filings and cells do to pooled rates: removal, reversals, decomposition, exclusions, accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratewright.operators.derive import PER_HOURS
from ratewright.operators.rates import pooled_rate, ratio
from ratewright.operators.stability import average_rank, matched, spearman, year_pairs
from ratewright.operators.without import sums_without

KEYS = ("naics3", "size_band")


def yearly(df: DataFrame) -> DataFrame:
    """year, n, hours and cases of plausible filings."""
    return df.filter(~F.col("implausible")).groupBy(F.col("year_filing_for").alias("year")).agg(F.count("*").alias("n"), F.sum("total_hours_worked").alias("h"), F.sum("recordable_cases").alias("c"))


def leave_one_filing_out(df: DataFrame) -> DataFrame:
    """Every plausible filing with its year's rate without it: a sum of the others, so that a dominant filing can't cancel."""
    own = df.filter(~F.col("implausible")).select("id", "establishment_id", F.col("year_filing_for").alias("year"), F.col("total_hours_worked").alias("hours"), F.col("recordable_cases").alias("cases")).filter("year is not null")
    out = sums_without(own, "year", "id", ("hours", "cases"))
    rate, without = pooled_rate(F.col("all_cases"), F.col("all_hours")), pooled_rate(F.col("without_cases"), F.col("without_hours"))
    return out.select("id", "establishment_id", "year", "hours", "cases", ratio(F.col("hours"), F.col("all_hours")).alias("hours_share"), ratio(F.col("cases"), F.col("all_cases")).alias("cases_share"), rate.alias("rate"), without.alias("rate_without"), (without - rate).alias("change"))


def influence_ranking(loo: DataFrame, most: int = 10) -> DataFrame:
    """The filings of each year whose removal moves its rate most; ties by id."""
    order = Window.partitionBy("year").orderBy(F.abs(F.col("change")).desc(), "id")
    return loo.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def exposure_concentration(loo: DataFrame) -> DataFrame:
    """By year: the sum of squared hours shares, how many equal filings would have it, the largest share, the largest influence."""
    hhi = F.sum(F.col("hours_share") * F.col("hours_share"))
    return loo.groupBy("year").agg(F.count("*").alias("n_filings"), hhi.alias("hours_hhi"), ratio(F.lit(1.0), hhi).alias("equivalent_filings"), F.max("hours_share").alias("top_hours_share"), F.max(F.abs(F.col("change"))).alias("max_abs_change"), F.max("change").alias("largest_rise"), F.min("change").alias("largest_fall"))


def trend_reversals(df: DataFrame) -> DataFrame:
    """Filings whose removal turns the sign of the change between two adjacent years, on either side."""
    loo = leave_one_filing_out(df)
    totals = yearly(df).select("year", pooled_rate(F.col("c"), F.col("h")).alias("r"))
    years = Window.orderBy("year")
    pairs = totals.withColumns({"year_to": F.lead("year").over(years), "r1": F.lead("r").over(years)}).filter("year_to is not null").select(F.col("year").alias("year_before"), F.col("year_to").alias("year_after"), F.col("r").alias("r0"), "r1")
    sides = []
    for side in ("year_before", "year_after"):
        at = loo.join(F.broadcast(pairs), F.col("year") == F.col(side))
        new0, new1 = (F.col("rate_without"), F.col("r1")) if side == "year_before" else (F.col("r0"), F.col("rate_without"))
        sides.append(at.filter((new1 - new0) * (F.col("r1") - F.col("r0")) < 0).select("year_before", "year_after", F.col(side).alias("removal_year"), "id", "hours", "cases", (100 * (F.col("r1") / F.col("r0") - 1)).alias("original_change_pct"), (100 * (new1 / new0 - 1)).alias("review_change_pct")))
    return sides[0].unionByName(sides[1])


def kitagawa(table: DataFrame) -> DataFrame:
    """Change of the rate between adjacent years over cells there in both: within cells, by composition, and what support leaves.

    within + composition = change of the matched rate, exactly.
    """
    cells = table.select("year_filing_for", *KEYS, "n", "hours_total", "cases_total", "aggregate_trir")
    by = Window.partitionBy("year_from", "year_to")
    z = matched(cells).select("year_from", "year_to", *KEYS, F.col("a.hours_total").alias("h0"), F.col("b.hours_total").alias("h1"), F.col("a.aggregate_trir").alias("r0"), F.col("b.aggregate_trir").alias("r1"))
    z = z.withColumns({"w0": F.col("h0") / F.sum("h0").over(by), "w1": F.col("h1") / F.sum("h1").over(by), "k0": average_rank("r0", "year_from", "year_to"), "k1": average_rank("r1", "year_from", "year_to")})
    w0, w1, r0, r1 = (F.col(c) for c in ("w0", "w1", "r0", "r1"))
    parts = z.groupBy("year_from", "year_to").agg(F.count("*").alias("n_cells_matched"), F.sum(w0 * r0).alias("m0"), F.sum(w1 * r1).alias("m1"), F.sum((w0 + w1) / 2 * (r1 - r0)).alias("within_effect"), F.sum((r0 + r1) / 2 * (w1 - w0)).alias("composition_effect"), F.count_if(r1 < r0).alias("declining_cells"), spearman("k0", "k1", 2).alias("rank_spearman"))
    whole = cells.groupBy("year_filing_for").agg(pooled_rate(F.sum("cases_total"), F.sum("hours_total")).alias("r"))
    a, b = whole.select(F.col("year_filing_for").alias("year_from"), F.col("r").alias("full0")), whole.select(F.col("year_filing_for").alias("year_to"), F.col("r").alias("full1"))
    out = parts.join(F.broadcast(a), "year_from").join(F.broadcast(b), "year_to")
    return out.select("year_from", "year_to", "n_cells_matched", (F.col("m1") - F.col("m0")).alias("matched_change"), "within_effect", "composition_effect", (F.col("full1") - F.col("full0") - (F.col("m1") - F.col("m0"))).alias("support_residual"), "declining_cells", "rank_spearman")


def leave_one_cell_out(table: DataFrame) -> DataFrame:
    """The change between adjacent years with each cell taken out of both; a cell of one year only counts as 0 in the other."""
    cells = table.select("year_filing_for", *KEYS, F.col("hours_total").alias("h"), F.col("cases_total").alias("c"))
    pairs = F.broadcast(year_pairs(cells))
    side = lambda y, i: cells.join(pairs, F.col("year_filing_for") == F.col(y)).select("year_from", "year_to", *KEYS, *(F.col(v).alias(f"{v}{i}") for v in "hc"))
    z = side("year_from", 0).join(side("year_to", 1), ["year_from", "year_to", *KEYS], "full").fillna(0.0)
    by = Window.partitionBy("year_from", "year_to")
    t = {v: F.sum(v).over(by) for v in ("h0", "h1", "c0", "c1")}
    before, after = (pooled_rate(t[f"c{i}"] - F.col(f"c{i}"), t[f"h{i}"] - F.col(f"h{i}")) for i in (0, 1))
    whole = pooled_rate(t["c1"], t["h1"]) - pooled_rate(t["c0"], t["h0"])
    out = z.select("year_from", "year_to", *KEYS, before.alias("rate_before"), after.alias("rate_after"), (after - before).alias("change_without"), whole.alias("change_original"))
    return out.withColumn("reversed", F.col("change_without") * F.col("change_original") < 0)


def exclusion_scenarios(df: DataFrame, tops: tuple[int, ...] = (1, 2, 10), employees: tuple[float, ...] = (100, 200)) -> DataFrame:
    """Each year's rate of plausible filings as they are, without the top n by hours, and without those above a size.

    Only filings whose rank can matter are ranked: a year's rows are cut to the largest before they are numbered.
    """
    good = df.filter(~F.col("implausible")).select("id", F.col("year_filing_for").alias("year"), F.col("total_hours_worked").alias("h"), F.col("recordable_cases").alias("c"), F.col("annual_average_employees").alias("e"))
    order = Window.partitionBy("year").orderBy(F.col("h").desc(), "id")
    top = good.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max(tops)).groupBy("year").agg(*(x for n in tops for x in (F.sum(F.when(F.col("rank") <= n, F.col("h"))).alias(f"h{n}"), F.sum(F.when(F.col("rank") <= n, F.col("c"))).alias(f"c{n}"))))
    whole = good.groupBy("year").agg(F.sum("h").alias("h"), F.sum("c").alias("c"), *(x for e in employees for x in (F.coalesce(F.sum(F.when(F.col("e") > e, F.col("h"))), F.lit(0.0)).alias(f"he{e:g}"), F.coalesce(F.sum(F.when(F.col("e") > e, F.col("c"))), F.lit(0.0)).alias(f"ce{e:g}"))))
    both = whole.join(F.broadcast(top), "year")
    scenario = lambda name, h, c: F.struct(F.lit(name).alias("scenario"), pooled_rate(F.col("c") - c, F.col("h") - h).alias("rate"), h.alias("removed_hours"), c.alias("removed_cases"))
    zero = F.lit(0.0)
    all_ = [scenario("baseline", zero, zero), *(scenario(f"without_top_{n}", F.col(f"h{n}"), F.col(f"c{n}")) for n in tops), *(scenario(f"without_above_{e:g}", F.col(f"he{e:g}"), F.col(f"ce{e:g}")) for e in employees)]
    return both.select("year", F.explode(F.array(*all_)).alias("s")).select("year", "s.*")


def without(df: DataFrame, excluded: DataFrame) -> DataFrame:
    """Plausible filings but those an analyst set aside; setting aside one that the screen rejects anyway is refused by key."""
    return df.filter(~F.col("implausible")).join(excluded.select("id").distinct(), "id", "left_anti")


def accounting(cases: Column, hours: Column, gone_cases: Column, gone_hours: Column) -> dict[str, Column]:
    """A removal's effect through its cases and through its hours: each averaged over both orders, so that they add up."""
    base, only_c = pooled_rate(cases, hours), pooled_rate(cases - gone_cases, hours)
    only_h, both = pooled_rate(cases, hours - gone_hours), pooled_rate(cases - gone_cases, hours - gone_hours)
    return {"baseline_rate": base, "cases_only_rate": only_c, "hours_only_rate": only_h, "joint_rate": both, "joint_change": both - base, "numerator_effect": ((only_c - base) + (both - only_h)) / 2, "denominator_effect": ((only_h - base) + (both - only_c)) / 2}


def deletion_accounting(df: DataFrame, tops: tuple[int, ...] = (1, 2)) -> DataFrame:
    """Accounting of removing each year's n filings of largest hours."""
    s = exclusion_scenarios(df, tops, ()).filter("scenario <> 'baseline'")
    t = s.join(F.broadcast(yearly(df)), "year")
    return t.select("year", "scenario", "removed_cases", "removed_hours", *(v.alias(k) for k, v in accounting(F.col("c"), F.col("h"), F.col("removed_cases"), F.col("removed_hours")).items()))


def scaled_rate(cases: Column, hours: Column, row_hours: Column, factor: float) -> Column:
    """The pooled rate if one row's hours were `factor` times as many; factors below 1 are refused."""
    if not factor >= 1 or factor == float("inf"):
        raise ValueError("the factor must be finite and at least 1")
    return PER_HOURS * cases / (hours + (factor - 1) * row_hours)


def removal_by_sides(df: DataFrame, by: str, order: str, cases: str, hours: str) -> DataFrame:
    """The group's rate without each row from sums of the rows before and after it: nothing is subtracted, so nothing cancels."""
    at = Window.partitionBy(by).orderBy(order)
    side = lambda c: F.coalesce(F.sum(c).over(at.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)) + F.coalesce(F.sum(c).over(at.rowsBetween(1, Window.unboundedFollowing)), F.lit(0.0))
    return df.withColumn("rate_without", pooled_rate(side(cases), side(hours)))
