"""Joins that must be one to one."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class MergeError(ValueError):
    """A join that isn't one to one; `found` has the counts."""

    def __init__(self, found: dict[str, int]):
        super().__init__("keys don't match one to one: " + ", ".join(f"{n} {k.replace('_', ' ')}" for k, n in found.items() if n))
        self.found = found


def key_counts(left: DataFrame, right: DataFrame, keys: Iterable[str]) -> dict[str, int]:
    """Keys that are repeated on either side, null, or on one side only: one aggregation of both sides' keys together."""
    keys = [*keys]
    tagged = lambda df, a, b: df.select(*keys, F.lit(a).alias("__l"), F.lit(b).alias("__r"))
    per = tagged(left, 1, 0).unionAll(tagged(right, 0, 1)).groupBy(*keys).agg(F.sum("__l").alias("__l"), F.sum("__r").alias("__r"))
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    counts = {"repeated_left": F.col("__l") > 1, "repeated_right": F.col("__r") > 1, "null_keys": null, "only_left": F.col("__r") == 0, "only_right": F.col("__l") == 0}
    return per.agg(*(F.count_if(c).alias(k) for k, c in counts.items())).first().asDict()


def one_to_one(left: DataFrame, right: DataFrame, keys: Iterable[str], how: str = "inner") -> DataFrame:
    """left joined with right, whose keys must be unique and not null on both sides.

    inner: every key must be on both sides. left: the right side may lack keys, and must have no others. Raises MergeError with the counts
    of all faults before anything is joined. Empty tables are one to one with each other.
    """
    if how not in ("inner", "left"):
        raise ValueError("one-to-one joins are inner or left")
    keys = [*keys]
    found = key_counts(left, right, keys)
    faults = {k: n for k, n in found.items() if n and not (how == "left" and k == "only_left")}
    if faults:
        raise MergeError(faults)
    return left.join(right, keys, how)
