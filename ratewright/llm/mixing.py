"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source is wanted target / source size times: a whole part all get, and a fraction as a
probability of one copy more. Two documents with fractional probabilities meet and one hands mass to the other,
in words, until one of them is at 0 or 1; which way is drawn so that each keeps its expectation. Words are thus
conserved at every meeting. Leaves of a few thousand documents leave one undecided document per source each,
and the undecided of many leaves meet in turn, level by level, until one per source remains. As a meeting decides the
document with less mass to move, that one is large; what its rounding misses, in words, is settled by small ones:
a bounded number of decided documents of each size class, drawn by hash, of which some change their mind.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratewright.llm.common import cut, maybe_broadcast, spare, words_of

WEIGHTS = (5, 2, 1)

#: Documents that a leaf of the reduction tree should hold, and undecided leaves that meet at the next level.
LEAF_ROWS, FAN_IN = 2_000, 64

#: Documents of each size class, a power of two, that are at hand to settle what is missed.
SETTLERS = 100


def draw(seed: int, *ids: object) -> float:
    """A number in [0, 1) that depends on its arguments alone: reruns draw the same."""
    return xxhash.xxh64_intdigest(repr(ids), seed=seed & 0x7FFFFFFF) / 2**64


def source_targets(sizes: DataFrame, most: float = 3.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, target of each source of `sizes` (source, size).

    Sources by code point, null last, get `weights` by turns; targets share the whole of all sizes by weight and
    stop at `most` times the source's own size. The level at which the rest share is found in closed form: by
    rising most * size / weight, a source is capped while the level that its successors would get exceeds that.
    The table has a row for each source; only such tables are ordered as a whole.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("double"))
    per = per.withColumn("bound", most * F.col("source_size"))
    by_level = Window.orderBy(F.col("bound") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("bound").over(before), F.lit(0.0))
    share = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    # the level if this and all later ones were not capped; the first source that stays below its bound sets it
    per = per.withColumn("level", left / share).withColumn("level", F.when(F.col("level") * F.col("weight") <= F.col("bound"), F.col("level")))
    level = F.first(F.col("level"), ignorenulls=True).over(by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return per.select("source", "source_size", F.least(F.col("bound"), level * F.col("weight")).alias("target"))


def rounded(seed: int, level: int):  # noqa: ANN201
    """A function for mapInArrow over rows sorted by (node, source): all documents of a node and source meet in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # node, source, doc_id, row, size, p
        for batch in batches:
            out: list[tuple] = []
            for node, row, doc_id, source, size, p in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("node", "row", "doc_id", "source", "size", "p")), strict=True):
                if held and held[:2] != (node, source):
                    out.append((*held[2:], held[1]))
                    held = None
                if held is None:
                    held = (node, source, doc_id, row, size, p)
                    continue
                _, _, doc2, row2, size2, p2 = held
                up = min((1 - p2) * size2, p * size)  # words the held one may gain
                down = min(p2 * size2, (1 - p) * size)
                if draw(seed, level, row, row2) * (up + down) < down:
                    p2, p = p2 + up / size2, p - up / size
                else:
                    p2, p = p2 - down / size2, p + down / size
                pair = [(doc2, row2, size2, p2), (doc_id, row, size, p)]
                pair = [(d, r, s, 0.0 if q < 1e-9 else 1.0 if q > 1 - 1e-9 else q) for d, r, s, q in pair]
                open_ = [x for x in pair if 0 < x[3] < 1]
                out += [(*x, source) for x in pair if not 0 < x[3] < 1]
                held = (node, source, *open_[0]) if open_ else None
            if out:
                yield records(out, batch.schema)
        if held:
            yield records([(*held[2:], held[1])], batch.schema)

    return run


def records(out: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    doc_id, row, size, p, source = zip(*out, strict=True)
    kind = lambda c: schema.field(c).type
    return pa.RecordBatch.from_arrays([pa.array(doc_id, type=kind("doc_id")), pa.array(row, type=pa.int64()), pa.array(size, type=pa.int64()), pa.array(p, type=pa.float64()), pa.array(source, type=kind("source"))], names=["doc_id", "row", "size", "p", "source"])


def copies(units: DataFrame, most: float = 3.0, weights: tuple[int, ...] = WEIGHTS, seed: int = 7, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """`units` (see there) with source_size, target and the whole number of copies that the mix takes.

    Leaves are dealt by a hash of the unit's key, so a source with any share of the rows spreads over all of them,
    and the same units always meet in the same order, whatever the partitions.
    """
    spark = units.sparkSession
    units = cut(units, "mix-units")
    n = units.count()
    targets = cut(source_targets(units.select("source", (F.col("size") * F.col("times")).alias("size")), most, weights), "mix-targets")
    targets_at = maybe_broadcast(targets.withColumnRenamed("source", "__source"), most=10_000)
    ratio = F.when((F.col("size") > 0) & (F.col("source_size") > 0), F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = units.join(targets_at, units["source"].eqNullSafe(F.col("__source")), "left").drop("__source").withColumn("ratio", ratio)
    rows = rows.withColumn("whole", F.floor(F.col("ratio") + 1e-9).cast("long")).withColumn("p", F.greatest(F.col("ratio") - F.col("whole"), F.lit(0.0)))
    open_ = rows.filter(F.col("p") > 1e-9).select("row", "doc_id", "source", (F.col("size") * F.col("times")).alias("size"), "p")
    nodes, level, settled = max(1, math.ceil(n / leaf_rows)), 0, []
    schema = f"doc_id {units.schema['doc_id'].dataType.simpleString()}, row long, size long, p double, source {units.schema['source'].dataType.simpleString()}"
    while True:
        parts = max(1, min(nodes, int(spark.conf.get("spark.sql.shuffle.partitions"))))
        placed = open_.withColumn("node", F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(nodes)))
        placed = placed.repartition(parts, "node").sortWithinPartitions("node", F.col("source").asc_nulls_last(), F.col("size").desc(), "doc_id", "row")
        met = cut(placed.mapInArrow(rounded(seed, level), schema), "mix-level")
        settled.append(met.filter((F.col("p") == 0) | (F.col("p") == 1)).select("row", "doc_id", F.col("p").cast("long").alias("extra")))
        open_ = met.filter((F.col("p") > 0) & (F.col("p") < 1)).select("row", "doc_id", "source", "size", "p")
        if nodes == 1:
            break
        nodes, level = math.ceil(nodes / FAN_IN), level + 1
    # one unit of each source is left at the root: it is taken or not, as is nearer
    settled.append(open_.select("row", "doc_id", (F.col("p") >= 0.5).cast("long").alias("extra")))
    extra = settled[0]
    for x in settled[1:]:
        extra = extra.unionByName(x)
    extra = extra.withColumnsRenamed({"row": "__row", "doc_id": "__id"})
    rows = rows.join(extra, (rows["row"] == F.col("__row")) & rows["doc_id"].eqNullSafe(F.col("__id")), "left")
    rows = cut(rows.select("row", "doc_id", "source", "size", "times", F.coalesce("source_size", F.lit(0)).alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target"), "p", "whole", F.coalesce("extra", F.lit(0)).cast("long").alias("extra")), "mix-rounded")
    flips = cut(settled_by(rows, seed), "mix-flips").select(F.col("row").alias("__row"), F.col("doc_id").alias("__id"), "flip")
    rows = rows.join(maybe_broadcast(flips), (rows["row"] == F.col("__row")) & rows["doc_id"].eqNullSafe(F.col("__id")), "left")
    return rows.select("row", "doc_id", "source", "size", "times", "source_size", "target", (F.col("whole") + F.col("extra") + F.coalesce("flip", F.lit(0))).alias("copies"))


def settled_by(rows: DataFrame, seed: int) -> DataFrame:
    """(row, doc_id, flip: 1 or -1) of the units whose fraction is rounded the other way, so that each source comes near its
    target: no single one of those at hand would bring it nearer.

    Of each source, rounding and size class those below a hash are at hand that leaves about SETTLERS; a task gets those
    of its sources, whose number doesn't grow with the documents'.
    """
    key = ["source", "extra", "class"]
    missed = rows.groupBy("source").agg(F.first("target").alias("target"), F.sum(F.col("size") * F.col("times") * (F.col("whole") + F.col("extra"))).alias("taken")).select(F.col("source").alias("s"), (F.col("target") - F.col("taken")).alias("missed"))
    open_ = rows.filter((F.col("p") > 1e-9) & (F.col("size") > 0)).select("source", "extra", (F.col("size") * F.col("times")).alias("words"), "row", "doc_id")
    open_ = open_.withColumn("class", F.floor(F.log2("words")).cast("int")).withColumn("u", F.xxhash64("row", F.lit(seed)) / 2.0**64 + 0.5)
    held = cut(open_.groupBy(*key).agg(((SETTLERS + 4 * SETTLERS**0.5) / F.count("*")).alias("share")).withColumnsRenamed({k: f"of_{k}" for k in key}), "mix-classes")
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in key))
    at_hand = open_.join(maybe_broadcast(held, most=100_000), same).filter(F.col("u") <= F.col("share"))
    hand = at_hand.groupBy("source").agg(F.collect_list(F.struct("extra", "words", "row", "doc_id")).alias("hand"))
    met = hand.join(maybe_broadcast(missed, most=10_000), hand["source"].eqNullSafe(F.col("s"))).filter(F.abs("missed") >= 0.5).select("missed", "hand")
    kind = rows.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for missed, hand in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out += settle(missed, hand)
            if out:
                row, doc_id, flip = zip(*out, strict=True)
                ids = batch.schema.field(1).type.value_type.field("doc_id").type
                yield pa.RecordBatch.from_arrays([pa.array(row, type=pa.int64()), pa.array(doc_id, type=ids), pa.array(flip, type=pa.int64())], names=["row", "doc_id", "flip"])

    return met.mapInArrow(run, f"row long, doc_id {kind.simpleString()}, flip long")


def settle(missed: float, hand: list[dict]) -> list[tuple]:
    """(row, doc_id, flip) of units of `hand` that bring what a source misses, in words, near 0: larger ones first, each if
    it leaves less than before. Ties go by row."""
    out = []
    for x in sorted(hand, key=lambda x: (-x["words"], x["row"])):
        flip = 1 if x["extra"] == 0 else -1
        if abs(missed - flip * x["words"]) < abs(missed):
            missed -= flip * x["words"]
            out.append((x["row"], x["doc_id"], flip))
    return out


def mixing_units(docs: DataFrame) -> DataFrame:
    """row (a key), doc_id, source, size, times: rows that agree in id, source and size are one unit, taken alike."""
    sized = docs.select("doc_id", "source", words_of(F.col("text")).alias("size"))
    return sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("times")).withColumn("row", F.xxhash64("doc_id", "source", "size"))


def mix(docs: DataFrame, most: float = 3.0, weights: tuple[int, ...] = WEIGHTS, seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, copies counted), copies, source: a row for each document.

    Null texts have size 0; documents of size 0, and all where every size is 0, are taken 0 times. A null source
    is a source, last in order. Repeated rows each give a row and are taken equally often. An empty table gives
    none; further columns are ignored. No document is taken more than `most` times. Reruns agree.
    """
    out = copies(mixing_units(docs), most, weights, seed)
    out = out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "source", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("k"))
    return out.drop("k")


def mixed_documents(docs: DataFrame, most: float = 3.0, weights: tuple[int, ...] = WEIGHTS, seed: int = 7) -> DataFrame:
    """The documents that the mix takes, with their own columns and mix_size, mix_target, mix_copies, mix_taken.

    A name that `docs` has already is lengthened by a low line. Nulls, empty texts, ties and repeated rows: see `mix`.
    """
    size, target, times, words = (spare(docs, c) for c in ("mix_size", "mix_target", "mix_copies", "mix_taken"))
    own_id, own_source, own_size = (spare(docs, c) for c in ("__id", "__source", "__size"))
    names = {"doc_id": own_id, "source": own_source, "size": own_size, "target": target, "copies": times}
    taken = copies(mixing_units(docs), most, weights, seed).filter(F.col("copies") > 0).select(*(F.col(a).alias(b) for a, b in names.items()))
    sized = docs.withColumn(size, words_of(F.col("text")))
    joined = sized.join(taken, sized["doc_id"].eqNullSafe(F.col(own_id)) & sized["source"].eqNullSafe(F.col(own_source)) & (F.col(size) == F.col(own_size)))
    return joined.select(*docs.columns, size, target, times, (F.col(size) * F.col(times)).alias(words))
