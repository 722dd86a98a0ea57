"""The plausibility screen: six flags and a verdict as one projection, and a table of rules that gives the same columns with messages."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewright.sources.schema import CASES

FLAGS = ("flag_hours_missing", "flag_employees_missing", "flag_negative_counts", "flag_hours_per_employee_high", "flag_hours_per_employee_low", "flag_no_injury_contradiction")
HOURS_IN_YEAR = 8760


@dataclass(frozen=True)
class Bounds:
    """Hours per employee that a filing may report, both ends included."""

    low: float = 120.0
    high: float = 4500.0
    contradiction_counts: bool = False

    def __post_init__(self) -> None:
        if self.low <= 0 or self.high <= self.low or self.high > HOURS_IN_YEAR:
            raise ValueError("bounds must satisfy 0 < low < high <= 8760")


def some(*flags: Column) -> Column:
    return reduce(lambda a, b: a | b, flags)


def finite(column: str) -> Column:
    """The value, null for NaN and infinities."""
    return F.when(F.abs(F.nanvl(F.col(column).cast("double"), F.lit(float("inf")))) < float("inf"), F.col(column))


def screened(df: DataFrame, bounds: Bounds = Bounds()) -> DataFrame:
    """Adds the six flags, never null, and `implausible`. One projection, inside generated code."""
    never = F.lit(False)
    hours, employees, cases, box = (finite(c) for c in ("total_hours_worked", "annual_average_employees", "recordable_cases", "no_injuries_illnesses")) if "no_injuries_illnesses" in df.columns else (*(finite(c) for c in ("total_hours_worked", "annual_average_employees", "recordable_cases")), None)
    ratio = hours / F.when(employees > 0, employees)
    negative = some(cases.isNull(), *(F.coalesce(finite(c) < 0, never) for c in CASES if c in df.columns))
    contradiction = never if box is None else F.coalesce(((box == 2) & (cases > 0)) | ((box == 1) & (cases == 0)), never)
    flags = dict(zip(FLAGS, (F.coalesce(hours <= 0, ~never), F.coalesce(employees < 1, ~never), negative, F.coalesce(ratio > bounds.high, never), F.coalesce(ratio < bounds.low, never), contradiction), strict=True))
    counted = FLAGS if bounds.contradiction_counts else FLAGS[:-1]
    return df.withColumns(flags).withColumn("implausible", some(*map(F.col, counted)))


@dataclass(frozen=True)
class Finding:
    """A rule: a flag, the condition under which it fires (three-valued SQL over the names of `terms`), what null means for
    it, whether it decides, and what a filer is told. `{low}` and `{high}` stand for the bounds."""

    flag: str
    condition: str
    if_unknown: bool
    decides: Callable[[Bounds], bool]
    message: str


ALWAYS: Callable[[Bounds], bool] = lambda b: True

FINDINGS = (
    Finding(FLAGS[0], "hours <= 0", True, ALWAYS, "No positive number of hours was reported, so no rate can be computed."),
    Finding(FLAGS[1], "staff < 1", True, ALWAYS, "Fewer than one employee on average, or none reported."),
    Finding(FLAGS[2], "least_count < 0", True, ALWAYS, "At least one kind of case is left out or below zero."),
    Finding(FLAGS[3], "hours_each > {high}", False, ALWAYS, "More than {high:g} hours for each employee."),
    Finding(FLAGS[4], "hours_each < {low}", False, ALWAYS, "Less than {low:g} hours for each employee."),
    Finding(FLAGS[5], "(box = 2 AND all_cases > 0) OR (box = 1 AND all_cases = 0)", False, lambda b: b.contradiction_counts, "The box on injuries says the opposite of the counts."),
)


def terms(df: DataFrame) -> dict[str, Column]:
    """What conditions may name: cleaned numbers of a filing. least_count and all_cases are null if one part is missing."""
    parts = [finite(c) for c in CASES]
    known = reduce(lambda a, b: a & b, (c.isNotNull() for c in parts))
    hours, staff = finite("total_hours_worked"), finite("annual_average_employees")
    box = finite("no_injuries_illnesses") if "no_injuries_illnesses" in df.columns else F.lit(None).cast("double")
    return {
        "hours": hours, "staff": staff, "hours_each": hours / F.when(staff > 0, staff), "box": box,
        "least_count": F.when(known, F.least(*parts)), "all_cases": reduce(lambda a, b: a + b, parts),
    }


def check_filings(df: DataFrame, bounds: Bounds = Bounds(), findings: tuple[Finding, ...] = FINDINGS) -> DataFrame:
    """`df` with a flag for each rule, `implausible`, and `messages` of the flags that fired."""
    named = terms(df)
    held = F.struct(*(v.alias(k) for k, v in named.items()))
    word = re.compile(rf"\b({'|'.join(named)})\b")
    values = {"low": bounds.low, "high": bounds.high}
    of = lambda f: F.coalesce(F.expr(word.sub(r"__terms.\1", f.condition.format(**values))), F.lit(f.if_unknown))
    out = df.withColumn("__terms", held).withColumns({f.flag: of(f) for f in findings}).drop("__terms")
    verdict = [F.col(f.flag) for f in findings if f.decides(bounds)]
    said = F.array_compact(F.array(*(F.when(F.col(f.flag), F.lit(f.message.format(**values))) for f in findings)))
    return out.withColumns({"implausible": some(*verdict) if verdict else F.lit(False), "messages": said})
