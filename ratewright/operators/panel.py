"""Establishments over years: key drift, coverage, transitions of the flag, odds ratios, and a permutation null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratewright.operators.rates import ratio
from ratewright.shared import cut


def key_drift(df: DataFrame) -> DataFrame:
    """metric, value: whether establishment_id is a stable key. Ids with several EINs, names or states, and missing ids."""
    per = df.filter("establishment_id is not null").groupBy("establishment_id").agg(*(F.count_distinct(c).alias(c) for c in ("ein", "company_name", "state")))
    found = per.agg(F.count("*").alias("ids"), *(F.count_if(F.col(c) > 1).alias(c) for c in ("ein", "company_name", "state")))
    missing = df.agg(F.count_if(F.col("establishment_id").isNull()).alias("missing"))
    names = {"distinct_establishment_ids": "ids", "filings_with_missing_establishment_id": "missing", "establishment_ids_with_multiple_ein": "ein", "establishment_ids_with_multiple_company_name": "company_name", "establishment_ids_with_multiple_state": "state"}
    return found.join(F.broadcast(missing)).select(F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), F.col(v).alias("value")) for k, v in names.items()))).alias("r")).select("r.*")


def flag_panel(df: DataFrame) -> DataFrame:
    """establishment_id, year, flag (0 or 1): kept long, one row for each filing."""
    return df.filter("establishment_id is not null and year_filing_for is not null").select("establishment_id", F.col("year_filing_for").alias("year"), F.col("implausible").cast("int").alias("flag"))


def panel_matrix(panel: DataFrame, years: list[int]) -> DataFrame:
    """The panel with a column for each of the named years, for display."""
    return panel.groupBy("establishment_id").pivot("year", years).agg(F.first("flag"))


def coverage(panel: DataFrame) -> DataFrame:
    """years_present, establishments: how many establishments filed in exactly so many years."""
    per = panel.groupBy("establishment_id").agg(F.count_distinct("year").alias("years_present"))
    return per.groupBy("years_present").agg(F.count("*").alias("establishments"))


def paired(panel: DataFrame) -> DataFrame:
    """Each filing with the establishment's filing in the next year of the panel, if there is one."""
    years = panel.select("year").distinct().withColumn("year_to", F.lead("year").over(Window.orderBy("year"))).filter("year_to is not null")  # a row a year
    a = panel.join(F.broadcast(years), "year").select("establishment_id", F.col("year").alias("year_from"), "year_to", F.col("flag").alias("was"))
    b = panel.select("establishment_id", F.col("year").alias("year_to"), F.col("flag").alias("is"))
    return a.join(b, ["establishment_id", "year_to"])


def odds_ratio(n11: Column, n10: Column, n01: Column, n00: Column) -> Column:
    return ratio((n11 * n00).cast("double"), n10 * n01)


def kappa(n11: Column, n10: Column, n01: Column, n00: Column) -> Column:
    """Cohen's kappa; null without rows or if chance agreement is complete."""
    n = F.when(n11 + n10 + n01 + n00 > 0, (n11 + n10 + n01 + n00).cast("double"))
    seen = (n11 + n00) / n
    chance = ((n11 + n10) * (n11 + n01) + (n01 + n00) * (n10 + n00)) / (n * n)
    return F.when(chance < 1, (seen - chance) / F.when(chance < 1, 1 - chance))


def transitions(panel: DataFrame) -> DataFrame:
    """2x2 counts, odds ratio and kappa of each pair of years, and of all pairs together (`pooled`)."""
    cell = lambda a, b: F.count_if((F.col("was") == a) & (F.col("is") == b))
    per = paired(panel).groupBy("year_from", "year_to").agg(cell(1, 1).alias("n11"), cell(1, 0).alias("n10"), cell(0, 1).alias("n01"), cell(0, 0).alias("n00"))
    per = per.withColumn("pair", F.concat("year_from", F.lit("-"), "year_to")).select("pair", "n11", "n10", "n01", "n00")
    both = per.unionByName(per.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n11", "n10", "n01", "n00"))).withColumn("pair", F.lit("pooled")))
    cells = [F.col(c) for c in ("n11", "n10", "n01", "n00")]
    n11, n10, n01, n00 = cells
    return both.select("pair", *cells, (n11 + n10 + n01 + n00).alias("n"), odds_ratio(*cells).alias("odds_ratio"), kappa(*cells).alias("kappa"), ratio(n11.cast("double"), n11 + n10).alias("p_flag_after_flag"), ratio(n01.cast("double"), n01 + n00).alias("p_flag_after_none"))


def enrichment(panel: DataFrame, year: int) -> DataFrame:
    """Of the establishments flagged in `year`: how many of those that file in the years beside it are flagged there, against all filers."""
    focus = panel.filter((F.col("year") == year) & (F.col("flag") == 1)).select("establishment_id").distinct()
    beside = panel.filter(F.col("year").isin(year - 1, year + 1))
    co = beside.join(focus, "establishment_id", "left_semi").groupBy("year").agg(F.count("*").alias("n_filers"), F.sum("flag").alias("n_flagged"))
    base = beside.groupBy("year").agg(F.avg("flag").alias("baseline"))
    out = base.join(co, "year", "left").select(F.concat(F.lit("flagged_in_"), F.col("year")).alias("comparison"), F.coalesce("n_filers", F.lit(0)).alias("n_filers"), F.coalesce("n_flagged", F.lit(0)).alias("n_flagged"), "baseline")
    own = panel.filter(F.col("year") == year).agg(F.count("*").alias("n_filers"), F.coalesce(F.sum("flag"), F.lit(0)).alias("n_flagged")).select(F.lit("focus_year").alias("comparison"), "n_filers", "n_flagged", F.lit(None).cast("double").alias("baseline"))
    share = ratio(F.col("n_flagged").cast("double"), F.col("n_filers"))
    return own.unionByName(out).select("comparison", "n_filers", "n_flagged", share.alias("flagged_share"), F.col("baseline").alias("baseline_rate"), ratio(share, F.col("baseline")).alias("enrichment_ratio"))


def permutation_null(panel: DataFrame, times: int = 200, seed: int = 20260909, margin: float = 6.0) -> DataFrame:
    """rep, odds_ratio of panels whose flags were dealt anew among each year's filers, as many as before.

    Only who is flagged moves: a filer (one row of its year) is flagged in a round if its digest ranks within the year's number of flags.
    Rounds are independent digests of the same rows. The last flagged one of each round and year is found first: filers
    whose digest lies `margin` deviations below the flagged share are only counted, those above it left out, and the few between ranked.
    Rounds and years whose last one isn't between rank all their filers. Then each pair of filings
    meets those bounds where it is read: only sums move. A round without any flag gives a row too.
    """
    spark, pairs = panel.sparkSession, cut(paired(panel), "pairs")
    size = panel.groupBy("year").agg(F.count("*").alias("n"), F.sum("flag").alias("k"))
    share, off = F.col("k") / F.col("n"), margin * F.sqrt((F.col("k") + 1.0) / (F.col("n") * F.col("n")))
    bounds = cut(size.select("year", "k", upto(share - off).alias("low"), upto(share + off).alias("near")), "shares")
    rounds = spark.range(times).select(F.col("id").cast("int").alias("rep"))
    ends_of = lambda c, is_from: pairs.select("establishment_id", F.col(c).alias("year"), F.lit(is_from).alias("nx"), F.lit(1 - is_from).alias("pv"))
    beside = ends_of("year_from", 1).unionByName(ends_of("year_to", 0)).groupBy("establishment_id", "year").agg(F.max("nx").alias("nx"), F.max("pv").alias("pv"))
    key = lambda year: F.concat_ws("|", F.lit(seed), F.col("establishment_id"), F.col(year), F.lit(""))
    reps = F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("rep")
    filers = panel.join(beside, ["establishment_id", "year"], "left").fillna(0, ["nx", "pv"]).join(F.broadcast(bounds), "year")
    every = filers.select("establishment_id", "year", "nx", "pv", "low", "near", key("year").alias("key")).select("*", reps).withColumn("digest", digest_of("key"))
    between, h = F.col("digest") > F.col("low"), F.substring("digest", 1, DIGITS)
    sums = (F.count("*").alias("m"), F.sum("nx").alias("nx"), F.sum("pv").alias("pv"))
    near = cut(every.filter(F.col("digest") <= F.col("near")).groupBy("rep", "year", F.when(between, h).alias("h"), F.when(between, F.col("establishment_id")).alias("e")).agg(*sums), "near")
    wanted = rounds.join(F.broadcast(bounds.select("year", "k").filter("k > 0")))

    def last(counted: DataFrame) -> DataFrame:
        """Of each round and year the last one flagged, and whether others have the same digits."""
        order = Window.partitionBy("rep", "year").orderBy(F.col("h").asc_nulls_first(), "e")
        placed = counted.withColumns({"upto": F.sum("m").over(order.rowsBetween(Window.unboundedPreceding, 0)), "tied": F.count("*").over(Window.partitionBy("rep", "year", "h")) > 1})
        return placed.join(F.broadcast(bounds.select("year", "k")), "year").filter("k > 0 and h is not null and upto >= k and upto - m < k").select("rep", "year", F.col("h").alias("last_h"), F.col("e").alias("last_e"), "tied")

    found = cut(last(near), "last")
    short = [f"{r.rep}:{r.year}" for r in wanted.join(found, ["rep", "year"], "left_anti").collect()]  # at most a row for each round and year
    if short:
        among = F.concat_ws(":", "rep", "year").isin(short)
        ranked = cut(every.filter(among).groupBy("rep", "year", h.alias("h"), F.col("establishment_id").alias("e")).agg(*sums), "ranked")
        near, found = near.filter(~among).unionByName(ranked), cut(found.unionByName(last(ranked)), "last")
    flagged = near.join(F.broadcast(found), ["rep", "year"]).filter("h is null or h < last_h or (h = last_h and e <= last_e)").groupBy("rep").agg(F.sum("nx").alias("n1"), F.sum("pv").alias("m1"))
    # both of a pair: the second digest is only taken of pairs whose first filing is flagged
    side = lambda c: found.select("rep", F.col("year").alias(f"year_{c}"), F.col("last_h").alias(f"h_{c}"), F.when(F.col("tied"), F.col("last_e")).alias(f"e_{c}"))
    years = pairs.select("year_from", "year_to").distinct().join(side("from"), "year_from").join(side("to"), ["year_to", "rep"])
    met = years.groupBy("year_from", "year_to").agg(F.collect_list(F.struct("rep", "h_from", "e_from", "h_to", "e_to")).alias("ends"))  # a row for each pair of years
    both = pairs.join(F.broadcast(met), ["year_from", "year_to"]).select("establishment_id", key("year_from").alias("key_from"), key("year_to").alias("key_to"), F.inline("ends"))
    for c in ("from", "to"):
        d, end = digest_of(f"key_{c}"), F.col(f"h_{c}")
        both = both.filter((d <= F.concat(end, F.lit("g"))) & (F.col(f"e_{c}").isNull() | (d < end) | (F.col("establishment_id") <= F.col(f"e_{c}"))))
    cells = rounds.join(F.broadcast(flagged), "rep", "left").join(F.broadcast(both.groupBy("rep").agg(F.count("*").alias("n11"))), "rep", "left").fillna(0)
    n11, n10, n01 = F.col("n11"), F.col("n1") - F.col("n11"), F.col("m1") - F.col("n11")
    return cells.join(F.broadcast(pairs.agg(F.count("*").alias("n")))).select("rep", odds_ratio(n11, n10, n01, F.col("n") - n11 - n10 - n01).alias("odds_ratio"))


#: Hexadecimal digits of a digest that count: those of even_number().
DIGITS = 13


def digest_of(key: str) -> Column:
    """The digest that even_number() takes of a key's parts and the round, as text: its order is that of the numbers."""
    return F.md5(F.concat(F.col(key), F.col("rep").cast("string")).cast("binary"))


def upto(share: Column) -> Column:
    """The text up to which digests stand for numbers of at most `share`: its digits, and a letter beyond them."""
    whole = F.floor(F.greatest(share, F.lit(0.0)) * float(16**DIGITS)).cast("long")
    return F.when(share < 0, F.lit("")).when(share >= 1, F.lit("g")).otherwise(F.concat(F.lower(F.lpad(F.hex(whole), DIGITS, "0")), F.lit("g")))
