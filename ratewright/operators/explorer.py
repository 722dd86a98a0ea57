"""Neighbourhoods of chosen objects in the object graph, as rows and as one JSON document for each choice."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewright.operators.graph import Store
from ratewright.shared import cut


def links_of(store: Store, names: tuple[str, ...] | None = None) -> DataFrame:
    """link, source_kind, source, target_kind, target of the named links (None: all), keys as text, each pair once."""
    rows = []
    for x in store.spec.links.values():
        if names is None or x.name in names:
            text = lambda c: F.col(c).cast("string")
            rows.append(store.link_rows(x.name).select(F.lit(x.name).alias("link"), F.lit(x.source).alias("source_kind"), text("source_key").alias("source"), F.lit(x.target).alias("target_kind"), text("target_key").alias("target")))
    if not rows:
        raise KeyError(f"no such links: {names}")
    return reduce(lambda a, b: a.unionByName(b), rows).distinct()


def neighbourhood(store: Store, chosen: DataFrame, steps: int = 2, links: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes: seed, kind, key, distance; edges: seed, link, source_kind, source, target_kind, target) around chosen (kind, key) objects.

    seed is kind:key. Links are followed from either end, `steps` times; a node has the least distance at which it is met. Each step looks only at
    what the last one has met first. Edges have both ends among the seed's nodes. Keys that no link has are nodes without edges.
    """
    pairs = cut(links_of(store, links), "links")
    ends = [("source", "target"), ("target", "source")]
    beside = reduce(lambda a, b: a.unionByName(b), (pairs.select(F.col(f"{a}_kind").alias("kind"), F.col(a).alias("key"), F.col(f"{b}_kind").alias("to_kind"), F.col(b).alias("to")) for a, b in ends))
    node = chosen.select(F.concat_ws(":", "kind", F.col("key").cast("string")).alias("seed"), "kind", F.col("key").cast("string").alias("key"), F.lit(0).alias("distance")).distinct()
    met, front = cut(node, "nodes"), node
    for k in range(1, steps + 1):
        reached = front.join(beside, ["kind", "key"]).select("seed", F.col("to_kind").alias("kind"), F.col("to").alias("key")).distinct()
        front = cut(reached.join(met, ["seed", "kind", "key"], "left_anti").withColumn("distance", F.lit(k)), "front")
        met = met.unionByName(front)
    ends_of = lambda a: met.select("seed", F.col("kind").alias(f"{a}_kind"), F.col("key").alias(a))
    edges = pairs.join(ends_of("source"), ["source_kind", "source"]).join(ends_of("target"), ["seed", "target_kind", "target"])
    return met, edges.select("seed", "link", "source_kind", "source", "target_kind", "target")


def documents(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """seed, payload: one JSON document for each seed with its nodes and edges in order, made by the executors.

    <, > and & are written as escapes, so that a page can hold the text in a script. A document is one value: for neighbourhoods that people look at.
    """
    some = nodes.groupBy("seed").agg(F.array_sort(F.collect_list(F.struct("distance", "kind", "key"))).alias("nodes"))
    met = edges.groupBy("seed").agg(F.array_sort(F.collect_list(F.struct("link", "source", "target"))).alias("edges"))
    out = some.join(met, "seed", "left").select("seed", F.to_json(F.struct("nodes", F.coalesce("edges", F.array().cast("array<struct<link:string,source:string,target:string>>")).alias("edges"))).alias("payload"))
    safe: Column = F.col("payload")
    for sign in "<>&":
        safe = F.replace(safe, F.lit(sign), F.lit(f"\\u{ord(sign):04x}"))
    return out.select("seed", safe.alias("payload"))
