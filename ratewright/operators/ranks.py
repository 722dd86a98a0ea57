"""Exact percentiles of groups of any size, by selection of ranks.

What a percentile needs of a group are one or two values of known rank. A pass over all rows counts the values of each group by equal
ranges between its least and its greatest value; only ranges that hold a wanted rank are looked into again. Ranges of few
rows are ranked exactly; larger ones are divided once more; one whose values are all equal needs no ranking. So no task holds a
group, and no table of its distinct values is kept anywhere.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratewright.shared import cut

#: Ranges that a span is divided into; rows of a span that one task may rank.
RANGES, RANKED = 4096, 200_000


def by_size(v: Column) -> Column:
    """A number's place on a scale of sizes: its logarithm, moved so that all positive ones lie above 0 and negative ones mirror them."""
    return F.when(v == 0, F.lit(0.0)).otherwise(F.signum(v) * (F.log(F.abs(v)) + 746))  # no double has a logarithm below -745.2


def range_of(v: Column, low: Column, high: Column, ranges: int, sizes: bool) -> Column:
    """Which of `ranges` + 1 ranges a value falls into: never falling with v, 0 for low and the last for high.

    Ranges are equal steps of the values, or with `sizes` of by_size(), where that tells low from high.
    """
    wide = F.abs(high / 2 - low / 2) > 4e307  # the difference may be beyond the largest double
    share = F.when(wide, (v / 2 - low / 2) / F.when(wide, high / 2 - low / 2)).otherwise((v - low) / F.when(~wide & (high > low), high - low))
    if sizes:
        told = by_size(high) > by_size(low)
        share = F.when(told, (by_size(v) - by_size(low)) / F.when(told, by_size(high) - by_size(low))).otherwise(share)
    return F.floor(share * ranges).cast("int")


def positions(share: float, n: Column) -> tuple[Column, Column, Column]:
    """The place of a percentile among n sorted values, and the ranks on its two sides."""
    at = F.lit(float(share)) * (n - 1)
    return at, F.floor(at).cast("long"), F.ceil(at).cast("long")


def percentiles(df: DataFrame, keys: Iterable[str], value: str, shares: Iterable[float], ranges: int = RANGES, ranked: int = RANKED) -> DataFrame:
    """keys, n_values, cuts: for each group the percentiles `shares` of a column, interpolated between neighbours.

    Missing values, NaN and infinities take no part, nor do rows with a null key; a group without values has no row. Without
    keys all rows are one group. Ties and repeated rows count each. An empty table gives no rows.
    """
    keys, shares = [*keys], [*shares]
    by = keys or ["__all"]
    v = F.col(value).cast("double")
    rows = df.select(*(F.col(k) if keys else F.lit(0).alias(k) for k in by), v.alias("__v")).filter(F.col("__v").isNotNull() & (F.abs("__v") < float("inf")))
    for k in keys:
        rows = rows.filter(F.col(k).isNotNull())
    ends = cut(rows.groupBy(*by).agg(F.count("*").alias("n_values"), F.min("__v").alias("__low"), F.max("__v").alias("__high")), "ends")
    ranks = F.array_distinct(F.flatten(F.array(*(F.array(*positions(p, F.col("n_values"))[1:]) for p in shares))))
    wanted = ends.select(*by, F.explode(ranks).alias("__rank"))
    # a span: values from low to high, of which there are `held`, after `before` lesser ones
    spans = ends.select(*by, "__low", "__high", F.lit(0).cast("long").alias("__before"), F.col("n_values").alias("__held"))
    inside = (F.col("__rank") >= F.col("__before")) & (F.col("__rank") < F.col("__before") + F.col("__held"))
    large = (F.col("__held") > ranked) & (F.col("__low") < F.col("__high"))
    sizes = False
    while not (open_ := spans.filter(large)).isEmpty():
        met = rows.join(open_, by).filter(F.col("__v").between(F.col("__low"), F.col("__high")))
        counted = met.groupBy(*by, "__low", "__before", range_of(F.col("__v"), F.col("__low"), F.col("__high"), ranges, sizes).alias("__range")).agg(F.count("*").alias("__n"), F.min("__v").alias("__a"), F.max("__v").alias("__b"))
        lesser = F.sum("__n").over(Window.partitionBy(*by, "__low").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
        parts = counted.select(*by, F.col("__a").alias("__low"), F.col("__b").alias("__high"), (F.col("__before") + F.coalesce(lesser, F.lit(0))).alias("__before"), F.col("__n").alias("__held"))
        hit = parts.join(wanted, by).filter(inside).drop("__rank").distinct()
        spans = cut(spans.filter(~large).unionByName(hit), "spans")
        sizes = not sizes  # steps by turns: of values for those close together, of sizes for those of all magnitudes
    even = F.col("__low") == F.col("__high")
    known = spans.filter(even).join(wanted, by).filter(inside).select(*by, "__rank", F.col("__low").alias("__v"))
    place = F.col("__before") + F.row_number().over(Window.partitionBy(*by, "__low").orderBy("__v")) - 1
    sorted_ = rows.join(spans.filter(~even), by).filter(F.col("__v").between(F.col("__low"), F.col("__high"))).select(*by, place.alias("__rank"), "__v").join(wanted, [*by, "__rank"])
    found = known.unionByName(sorted_.select(*by, "__rank", "__v")).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("__rank", "__v"))).alias("__at")).join(ends.select(*by, "n_values"), by)

    def between(p: float) -> Column:
        at, low, high = positions(p, F.col("n_values"))
        a, b = F.element_at("__at", low), F.element_at("__at", high)
        return F.when(a == b, a).otherwise((high - at) * a + (at - low) * b)

    return found.select(*keys, "n_values", F.array(*map(between, shares)).alias("cuts"))


def with_median(groups: DataFrame, rows: DataFrame, keys: Iterable[str], value: str, name: str) -> DataFrame:
    """`groups` (a row for each value of `keys`, none null) with the exact median of a column of `rows`, null where there are no values."""
    keys = [*keys]
    found = percentiles(rows, keys, value, [0.5]).select(*keys, F.get("cuts", F.lit(0)).alias(name))
    return groups.join(found, keys, "left") if keys else groups.join(found, how="left")
