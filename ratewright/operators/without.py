"""Sums of a group without each of its rows, made of additions only.

total - own value loses all digits where one row holds nearly everything. Here the sums on both sides of a row are added: a group
is dealt into blocks of bounded size; the sums before and after a row inside its block, and the sums of the blocks before
and after, are running sums. No task holds or reads a group, and nothing is subtracted.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block if all are of one group, as a mean: rows are dealt by a hash of their key.
ROWS = 4096


def sides(value: str | Column, window: Window) -> Column:
    """The sum of a column over the rows before and after this one."""
    before, after = window.rowsBetween(Window.unboundedPreceding, -1), window.rowsBetween(1, Window.unboundedFollowing)
    return F.coalesce(F.sum(value).over(before), F.lit(0.0)) + F.coalesce(F.sum(value).over(after), F.lit(0.0))


def sums_without(df: DataFrame, by: str, key: str, values: Iterable[str], rows: int = ROWS) -> DataFrame:
    """`df` with, for each of `values`, without_<value> (the group's sum without this row) and all_<value> (its whole sum).

    Missing values add nothing; a row that is alone has sums of 0. Rows of equal key are rows of their own. Rows with a null group are a
    group. An empty table gives no rows. Every group has as many blocks as the whole table needs: a join with the groups' own sizes
    would bring a group's rows together first.
    """
    values = [*values]
    sized = df.agg(F.ceil(F.count("*") / rows).cast("long").alias("__blocks"))
    dealt = df.crossJoin(F.broadcast(sized)).withColumn("__block", F.pmod(F.xxhash64(key), F.col("__blocks"))).drop("__blocks")
    blocks = dealt.groupBy(by, "__block").agg(*(F.coalesce(F.sum(v), F.lit(0.0)).alias(f"__s_{v}") for v in values))
    order = Window.partitionBy(by).orderBy("__block")
    others = blocks.select(F.col(by).alias("__by"), F.col("__block").alias("__b"), *(sides(f"__s_{v}", order).alias(f"__o_{v}") for v in values), *(F.sum(f"__s_{v}").over(Window.partitionBy(by)).alias(f"all_{v}") for v in values))
    place = Window.partitionBy(by, "__block").orderBy(key)
    inner = dealt.select("*", *(sides(v, place).alias(f"__i_{v}") for v in values))
    out = inner.join(others, inner[by].eqNullSafe(others["__by"]) & (inner["__block"] == others["__b"]))
    return out.select(*df.columns, *((F.col(f"__i_{v}") + F.col(f"__o_{v}")).alias(f"without_{v}") for v in values), *(f"all_{v}" for v in values))
