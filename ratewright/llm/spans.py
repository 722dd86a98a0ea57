"""Matches of patterns with their places, by DataFrame functions alone.

`regexp_extract_all` gives the matches and `split` the text between them; both walk the same leftmost,
non-overlapping matches, so running lengths of both give each match's place in code points.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,match:string>>"
SPAN_BETWEEN = "array<struct<start:int,end:int,match:string,left:string,right:string>>"


@dataclass(frozen=True)
class Rule:
    """A kind of span: a Java pattern, and what a match must fulfil to stay (dropped matches are not retried)."""

    kind: str
    pattern: str
    passes: Callable[[Column], Column] | None = None


def matches(text: Column, rule: Rule) -> Column:
    return F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))


#: Steps of an inner walk: its items are appended to an array, which is copied for each of them.
BLOCK = 64

#: Code points of a chunk of a text.
CHUNK = 512


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where `value` is worked out once however often it is named."""
    return F.transform(F.array(value), use)[0]


def gathered(size: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column, Column]], kind: str) -> Column:
    """The items that `step` keeps, as an array of type `kind`, while a number goes from 0 to size - 1.

    step(state, i) gives the next state, whether to keep an item, and the item. The state must be small: a number or a few. Blocks
    of steps are walked twice, first for the state that each begins with, then for its items, so that no array
    of all items is copied from step to step. What `step` looks up in arrays must be columns or bound().
    """
    empty = lambda of: F.array().cast(of)
    steps = lambda k: F.sequence(k * BLOCK, F.least(size - 1, k * BLOCK + BLOCK - 1))

    def one(acc: Column, i: Column) -> Column:
        then, keep, item = step(acc["state"], i)
        return F.struct(then.alias("state"), F.when(keep, F.array_append(acc["out"], item)).otherwise(acc["out"]).alias("out"))

    def items(states: Column) -> Column:
        return F.flatten(F.transform(blocks, lambda k: F.aggregate(steps(k), F.struct(F.get(states, k).alias("state"), empty(kind).alias("out")), one, lambda acc: acc["out"])))

    blocks = F.sequence(F.lit(0), F.floor((size - 1) / BLOCK).cast("int"))
    states = F.aggregate(blocks, F.array(state), lambda acc, k: F.array_append(acc, F.aggregate(steps(k), F.element_at(acc, -1), lambda at, i: step(at, i)[0])))
    return F.when(size > 0, bound(states, items)).otherwise(empty(kind))


def placed(text: Column, found: Column, rule: Rule, reach: int = 0) -> Column:
    """array<struct<start, end, match>> of the matches in `found` that pass, end exclusive; empty without matches.

    With a `reach`, also left and right: so many code points of the text since the match before, and until the next.
    """

    def walk(of: Column) -> Column:
        def step(at: Column, i: Column) -> tuple[Column, Column, Column]:
            match, piece = F.get(of["found"], i), F.get(of["between"], i)
            start = at + F.length(piece)
            end = start + F.length(match)
            span = [start.alias("start"), end.alias("end"), match.alias("match")]
            if reach:
                span += [F.right(piece, F.lit(reach)).alias("left"), F.left(F.get(of["between"], i + 1), F.lit(reach)).alias("right")]
            return end, rule.passes(match) if rule.passes else F.lit(True), F.struct(*span)

        return gathered(F.size(of["found"]), F.lit(0), step, SPAN_BETWEEN if reach else SPAN)

    # the text is split only where there is something between to be known
    some = F.struct(found.alias("found"), F.when(F.size(found) > 0, F.split(text, rule.pattern)).alias("between"))
    return bound(some, walk)


def chunks(text: Column) -> Column:
    """A text in chunks of CHUNK code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def part(chunked: Column, start: Column, end: Column) -> Column:
    """The code points from start to end (exclusive) of a text in chunks; only the chunks between are looked at."""
    first, last = F.floor(start / CHUNK).cast("int"), F.floor((end - 1) / CHUNK).cast("int")
    met = F.array_join(F.transform(F.sequence(first, last), lambda k: F.get(chunked, k)), "")
    return F.when(end > start, F.substring(met, start - first * CHUNK + 1, end - start)).otherwise(F.lit(""))


#: Steps by which a sorted array is searched.
HALVES = tuple(1 << k for k in range(30, -1, -1))


def below(numbers: Column, value: Column) -> Column:
    """How many of an ascending array's numbers are less than `value`, by halving."""
    return F.aggregate(F.array(*(F.lit(h) for h in HALVES)), F.lit(0), lambda n, h: F.when((h <= F.size(numbers) - n) & (F.get(numbers, n + h - 1) < value), n + h).otherwise(n))


def reached(spans: Column) -> Column:
    """struct<starts, ends> of (start, end) structs in order of start: where each begins, and how far it or one before it reaches."""

    def walk(x: Column) -> Column:
        tops = gathered(F.size(x), F.lit(0), lambda top, i: (F.greatest(top, F.get(x, i)["end"]), F.lit(True), F.greatest(top, F.get(x, i)["end"])), "array<int>")
        return F.struct(F.transform(x, lambda s: s["start"]).alias("starts"), tops.alias("ends"))

    return bound(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))), walk)


def clear(within: Column, start: Column, end: Column) -> Column:
    """Whether a span overlaps none of those that reached() has seen."""
    before = below(within["starts"], end)
    return F.when(F.size(within["starts"]) == 0, F.lit(True)).otherwise(bound(before, lambda n: (n == 0) | (F.get(within["ends"], n - 1) <= start)))


def marked(spans: Column, rank: int, kind: str) -> Column:
    """array<struct<start, rank, end, kind>> of a span array."""
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind")))


def joined(spans: list[tuple[int, str, Column]]) -> Column:
    """kind:start:end of (rank, kind, span array), by start, then rank, comma-joined."""
    return written(F.concat(*(marked(s, r, k) for r, k, s in spans)))


def written(marked: Column) -> Column:
    """kind:start:end of array<struct<start, rank, end, kind>>, by start, then rank, comma-joined."""
    return F.concat_ws(",", F.transform(F.array_sort(marked), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))
