"""Expectations about tables, compiled to one aggregation for each table; and the lineage of stages and artifacts."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Expectation:
    """id, table, kind with its arguments; severity error or warn; what to do if the table isn't there: fail or skip."""

    id: str
    table: str
    kind: str
    args: dict = field(default_factory=dict)
    severity: str = "error"
    if_missing: str = "fail"
    where: dict = field(default_factory=dict)
    where_prefix: dict = field(default_factory=dict)


def all_true(c: Column) -> Column:
    """Whether a condition holds in every row; a null doesn't hold."""
    return F.count_if(~F.coalesce(c, F.lit(False))) == 0


def near(a: Column, b: Column, tolerance: float) -> Column:
    return F.abs(a - b) <= tolerance * F.greatest(F.lit(1.0), F.abs(a), F.abs(b))


def added(columns: list[str]) -> Column:
    return reduce(lambda a, b: a + b, map(F.col, columns))


def by_row(a: dict) -> Column:
    """Kinds that look at each row by itself: (arguments) to a condition."""
    t = a.get("tolerance", 1e-9)
    forms: dict[str, Callable[[], Column]] = {
        "range": lambda: (F.col(a["column"]) >= a.get("low", -math.inf)) & (F.col(a["column"]) <= a.get("high", math.inf)) | (F.col(a["column"]).isNull() if a.get("nullable") else F.lit(False)),
        "value_in": lambda: F.col(a["column"]).isin(*a["values"]), "col_le": lambda: F.col(a["left"]) <= F.col(a["right"]) + t,
        "sum_columns": lambda: near(added(a["columns"]), F.col(a["total"]), t), "ratio": lambda: near(F.col(a["numerator"]) / F.when(F.col(a["denominator"]) != 0, F.col(a["denominator"])) * a.get("scale", 1.0), F.col(a["column"]), t),
        "linear": lambda: near(sum((F.col(c) * k for c, k in a["terms"].items()), F.lit(a.get("constant", 0.0))), F.col(a["column"]), t),
        "monotone_row": lambda: reduce(lambda x, y: x & y, (F.col(p) <= F.col(q) + t for p, q in zip(a["columns"], a["columns"][1:], strict=False))),
        "not_null": lambda: reduce(lambda x, y: x & y, (F.col(c).isNotNull() for c in a["columns"])),
    }
    return forms[a["__kind"]]()


ROW_KINDS = ("range", "value_in", "col_le", "sum_columns", "ratio", "linear", "monotone_row", "not_null")


def aggregate_of(e: Expectation) -> Column | None:
    """The expectation as one aggregate of its table, if it is one."""
    a = e.args | {"__kind": e.kind}
    t = a.get("tolerance", 1e-9)
    if e.kind in ROW_KINDS:
        return all_true(by_row(a))
    if e.kind == "rows":
        return (F.count("*") >= a.get("low", 0)) & (F.count("*") <= a.get("high", 2**62))
    if e.kind == "value_set":
        return F.array_sort(F.collect_set(F.col(a["column"]).cast("string"))) == F.array(*(F.lit(str(v)) for v in sorted(map(str, a["values"]))))
    if e.kind == "years":
        return F.array_sort(F.collect_set(F.col(a.get("column", "year")).cast("int"))) == F.array(*map(F.lit, sorted(a["years"])))
    if e.kind == "scalar":
        return near(F.expr(a["expression"]).cast("double"), F.lit(float(a["value"])), t)
    return None


def narrowed(df: DataFrame, e: Expectation) -> DataFrame:
    for c, v in e.where.items():
        df = df.filter(F.col(c).eqNullSafe(F.lit(v)))
    for c, v in e.where_prefix.items():
        df = df.filter(F.col(c).cast("string").startswith(v))
    return df


def own_query(df: DataFrame, e: Expectation, tables: dict[str, DataFrame]) -> DataFrame:
    """Kinds that need groups, order or another table: a frame of one row and one boolean."""
    a, t = e.args, e.args.get("tolerance", 1e-9)
    one = lambda d, c: d.agg(c.alias("ok"))
    if e.kind == "unique":
        return one(df.groupBy(*a["columns"]).count(), F.count_if(F.col("count") > 1) == 0)
    if e.kind == "monotone_col":
        w = Window.partitionBy(*a.get("by", [])).orderBy(a["order"])
        step = F.col(a["column"]) - F.lag(a["column"]).over(w)
        return one(df.select((step if a.get("rising", True) else -step).alias("d")), F.count_if(F.col("d") < -t) == 0)
    if e.kind == "group_sum":
        return one(df.groupBy(*a["by"]).agg(F.sum(a["column"]).alias("s")), all_true(near(F.col("s"), F.lit(float(a["value"])), t)))
    if e.kind == "lookup":
        other = tables[a["other"]].select(*(F.col(c).alias(f"__{i}") for i, c in enumerate(a["other_columns"])))
        return one(df.join(other, [F.col(c) == F.col(f"__{i}") for i, c in enumerate(a["columns"])], "left_anti"), F.count("*") == 0)
    if e.kind == "sum_ref":
        return df.agg(F.sum(a["column"]).alias("s")).crossJoin(tables[a["other"]].agg(F.sum(a["other_column"]).alias("r"))).select(near(F.col("s"), F.col("r"), t).alias("ok"))
    if e.kind == "scalar_diff":
        return df.agg(F.expr(a["expression"]).cast("double").alias("s")).crossJoin(tables[a["other"]].agg(F.expr(a["other_expression"]).cast("double").alias("r"))).select(near(F.col("s") - F.col("r"), F.lit(float(a.get("value", 0))), t).alias("ok"))
    raise ValueError(f"unknown kind: {e.kind}")


def check(spark: SparkSession, tables: dict[str, DataFrame], expectations: list[Expectation], strict: bool = False) -> DataFrame:
    """id, table, kind, severity, status (pass, fail, skip), detail. What belongs to one table and filter is one aggregation.

    An expectation that can't be evaluated fails. `strict` turns skips into failures.
    """
    out: list[tuple] = []
    say = lambda e, status, detail="": out.append((e.id, e.table, e.kind, e.severity, "fail" if strict and status == "skip" else status, detail))
    batches: dict[tuple, list[Expectation]] = {}
    for e in expectations:
        if e.table not in tables:
            say(e, "fail" if e.if_missing == "fail" else "skip", "no such table")
        elif e.kind == "columns":
            missing = [c for c in e.args["columns"] if c not in tables[e.table].columns]
            say(e, "fail" if missing else "pass", f"missing {missing}" if missing else "")
        else:
            batches.setdefault((e.table, str(sorted(e.where.items())), str(sorted(e.where_prefix.items()))), []).append(e)
    for (table, *_), own in batches.items():
        together = []
        for e in own:
            try:
                df = narrowed(tables[table], e)
                if (c := aggregate_of(e)) is None:
                    say(e, "pass" if own_query(df, e, tables).first()[0] else "fail")
                else:
                    df.agg(c)  # names and types are checked here, without running
                    together.append((e, c))
            except Exception as x:  # an expectation that can't be evaluated is one that isn't met
                say(e, "fail", type(x).__name__)
        if together:
            df = narrowed(tables[table], together[0][0])
            try:
                row = df.agg(*(c.alias(f"r{i}") for i, (_, c) in enumerate(together))).first()
                for i, (e, _) in enumerate(together):
                    say(e, "pass" if row[i] else "fail")
            except Exception:
                for e, c in together:
                    try:
                        say(e, "pass" if df.agg(c).first()[0] else "fail")
                    except Exception as x:
                        say(e, "fail", type(x).__name__)
    return spark.createDataFrame(out, "id string, table string, kind string, severity string, status string, detail string")


@dataclass(frozen=True)
class Stage:
    """A step that reads artifacts and writes others."""

    name: str
    reads: tuple[str, ...]
    writes: tuple[str, ...]


class LineageError(ValueError):
    pass


def topological(stages: list[Stage], sources: set[str]) -> list[str]:
    """The stages in an order in which every artifact is written before it is read; raises on what can't be ordered."""
    writers: dict[str, str] = {}
    for s in stages:
        for a in s.writes:
            if a in writers or a in sources:
                raise LineageError(f"{a} has two writers")
            writers[a] = s.name
    for s in stages:
        if lost := [a for a in s.reads if a not in writers and a not in sources]:
            raise LineageError(f"{s.name} reads what nothing writes: {lost}")
    waits = {s.name: {writers[a] for a in s.reads if a in writers} for s in stages}
    if len(waits) != len(stages):
        raise LineageError("two stages have one name")
    done: list[str] = []
    while ready := sorted(n for n, w in waits.items() if n not in done and w <= set(done)):
        done += ready
    if len(done) < len(stages):
        raise LineageError(f"a cycle through {sorted(set(waits) - set(done))}")
    return done


def lineage_table(spark: SparkSession, stages: list[Stage], sources: set[str]) -> DataFrame:
    """stage, place, artifact, direction: the graph as rows, in order."""
    place = {n: i for i, n in enumerate(topological(stages, sources))}
    rows = [(s.name, place[s.name], a, d) for s in stages for d, own in (("reads", s.reads), ("writes", s.writes)) for a in own]
    return spark.createDataFrame(rows, "stage string, place long, artifact string, direction string")
