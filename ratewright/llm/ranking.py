"""Ranked search over an index in shards: posting blocks of variable length, and exact search that skips blocks.

A shard holds some documents that one task has read: their ids and lengths, and for each term the documents that hold it
with their frequencies. Where a posting list is cut into blocks is found by dynamic programming: of all cuts, the one for which
the error of the bounds - over all documents that a block spans, its highest score less their own - plus a cost for each
block is least. A search adds up the highest scores of the blocks that reach over each document, which bounds its score,
and looks into blocks only where the bound reaches the score of the last place that is still held; that score goes on from
shard to shard of a task.

All scores are whole numbers, so results don't depend on shards, blocks or order.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratewright.llm.common import CHUNK_BYTES, cut, footprint, pieces_of, slices

#: Bytes of terms: digits, letters (A-Z as a-z) and all beyond ASCII; any other byte is a blank. 0xFF, which UTF-8 has not, ends a text.
FOLD = bytes(b + 32 if 65 <= b <= 90 else 0xFE if b == 0xFF else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
BREAK = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")

#: Postings and documents from which a task begins another shard.
SHARD_POSTINGS, SHARD_DOCS = 1_000_000, 500_000

#: Postings of a run; a list is cut in runs, and blocks are found for all runs at once.
RUN = 64

#: What a block costs, in the unit of a term's score before its weight (0 to 1,000,000).
BLOCK_COST = 1_000_000

#: Bytes of the texts that are searched for at once, and the terms up to which an index is built for them alone.
QUERY_BYTES, TERMS = 4 << 20, 500_000

SHARD = "doc_ids binary, has_id binary, lengths binary, terms array<binary>, sizes array<bigint>, places binary, counts binary, n_docs long, n_terms long"


def terms_of(text: str | None) -> Counter[bytes]:
    return Counter((text or "").encode().translate(FOLD).split())


class Builder:
    """The shard that a task is filling. known: terms that are indexed (None: all)."""

    def __init__(self, known: dict[bytes, int] | None):
        self.known = known
        self.begin()

    def begin(self) -> None:
        self.ids: list[int | None] = []
        self.lengths: list[np.ndarray] = []
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.own: dict[bytes, int] = {}
        self.postings = 0

    def number(self, words: list[bytes]) -> np.ndarray:
        """The number of each word; 0 for those that aren't indexed."""
        if self.known is not None:
            return np.fromiter(map(self.known.get, words, repeat(0)), dtype=np.int64, count=len(words))
        own = self.own
        for w in set(words).difference(own):
            own[w] = len(own) + 1
        return np.fromiter(map(own.__getitem__, words), dtype=np.int64, count=len(words))

    def add(self, ids: list[int | None], texts: list[bytes]) -> None:
        """Texts with their ids; those of several megabytes go through in pieces."""
        first = len(self.ids)
        self.ids += ids
        if len(texts) == 1 and len(texts[0]) > CHUNK_BYTES:
            total = 0
            for piece in pieces_of(texts[0], BREAK):
                words = piece.translate(FOLD).split()
                total += len(words)
                self.hold(np.full(len(words), first), self.number(words))
            self.lengths.append(np.array([total], dtype=np.int64))
            return
        words = b" \xff ".join([*(t.translate(FOLD) for t in texts), b""]).split()
        ends = np.fromiter(map(b"\xff".__eq__, words), dtype=bool, count=len(words))
        doc = (np.cumsum(ends) - ends)[~ends]
        self.lengths.append(np.bincount(doc, minlength=len(texts)).astype(np.int64))
        self.hold(doc + first, self.number([w for w in words if w != b"\xff"]))

    def hold(self, doc: np.ndarray, term: np.ndarray) -> None:
        some = term > 0
        key, n = np.unique(term[some] << 32 | doc[some], return_counts=True)
        self.found.append((key >> 32, key & 0xFFFFFFFF, n))
        self.postings += key.size

    def full(self) -> bool:
        return self.postings >= SHARD_POSTINGS or len(self.ids) >= SHARD_DOCS

    def shard(self) -> Iterator[pa.RecordBatch]:
        if not self.ids:
            return
        names = [b"", *(self.own if self.known is None else self.known)]
        term, doc, n = (np.concatenate(x) for x in zip(*self.found, strict=True))
        key, back = np.unique(term << 32 | doc, return_inverse=True)  # a long text has a term in several pieces
        counts = np.zeros(key.size, dtype=np.int64)
        np.add.at(counts, back, n)
        term, place = key >> 32, key & 0xFFFFFFFF
        own, sizes = np.unique(term, return_counts=True)
        lengths = np.concatenate(self.lengths)
        binary = lambda x: pa.array([x.tobytes()], type=pa.binary())
        yield pa.RecordBatch.from_arrays(
            [
                binary(np.array([i or 0 for i in self.ids], dtype=np.int64)), binary(np.array([i is not None for i in self.ids])), binary(lengths), pa.array([[names[i] for i in own.tolist()]], type=pa.list_(pa.binary())),
                pa.array([sizes.tolist()], type=pa.list_(pa.int64())), binary(place.astype(np.int32)), binary(counts.astype(np.int64 if counts.size and counts.max() >= 1 << 31 else np.int32)), pa.array([int((lengths > 0).sum())], type=pa.int64()), pa.array([int(lengths.sum())], type=pa.int64()),
            ],
            names=[f.split(" ")[0] for f in SHARD.split(", ")],
        )
        self.begin()


@dataclass(frozen=True)
class Index:
    """Shards in the shared folder, the documents with a term, and all terms of all documents."""

    shards: DataFrame
    documents: int
    terms: int

    def frequencies(self, terms: list[bytes]) -> dict[bytes, int]:
        """The documents that hold each of these terms."""
        spark = self.shards.sparkSession
        wanted = spark.createDataFrame([(bytearray(t),) for t in terms], "term binary")
        every = self.shards.select(F.explode(F.arrays_zip("terms", "sizes")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.sizes").alias("n"))
        return {bytes(t): n for t, n in every.join(F.broadcast(wanted), "term").groupBy("term").agg(F.sum("n")).collect()}


def build_index(docs: DataFrame, terms: list[bytes] | None = None, doc_id: str = "doc_id", text: str = "text") -> Index:
    """An index of all rows of `docs`, over these terms alone if some are given: lengths and statistics count all terms all the same.

    Shards are made where rows are read, without a shuffle. Null texts have no terms; each of repeated rows is a document.
    """
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(None if terms is None else {t: i + 1 for i, t in enumerate(terms)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        builder = Builder(known.value)
        for batch in batches:
            for part in slices(batch, "__text"):
                builder.add(part.column(0).to_pylist(), [t or b"" for t in pc.cast(part.column(1), pa.binary()).to_pylist()])
                if builder.full():
                    yield from builder.shard()
        yield from builder.shard()

    made = docs.select(F.col(doc_id).cast("long").alias("__id"), F.col(text).alias("__text")).mapInArrow(run, SHARD)
    shards = cut(made, "shards")
    n, total = shards.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    return Index(shards, n, total)


def block_starts(scores: np.ndarray, docs: np.ndarray, sizes: np.ndarray, cost: int = BLOCK_COST) -> np.ndarray:
    """Where blocks begin in `scores`, which are lists of `sizes` one after the other: the cuts of least error plus cost in each run.

    docs: ascending in each list. least[i] is the least sum for the first i postings of a run, over all places j where its last block may begin. All
    runs go through the steps together, longest first, so that a step is over the runs that are that long.
    """
    if not scores.size:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(sizes)
    runs = -(-sizes // RUN)
    number = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)  # of the run in its list
    start = np.repeat(ends - sizes, runs) + number * RUN
    length = np.minimum(RUN, np.repeat(ends, runs) - start)
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    active = np.searchsorted(-length, -np.arange(RUN + 1), side="right")  # runs of i postings or more
    places = np.minimum(start[:, None] + np.arange(RUN), scores.size - 1)
    s, d = scores[places].T.copy(), docs[places].T.copy()
    least = np.zeros((RUN + 1, start.size), dtype=np.int64)
    last = np.zeros((RUN + 1, start.size), dtype=np.int16)
    for i in range(1, int(length[0]) + 1):
        n = active[i]
        high, best, where = np.zeros(n, dtype=np.int64), np.full(n, np.iinfo(np.int64).max), np.zeros(n, dtype=np.int16)
        for j in range(i - 1, -1, -1):
            np.maximum(high, s[j, :n], out=high)
            now = least[j, :n] + (d[i - 1, :n] - d[j, :n] + 1) * high + cost
            better = now < best
            best[better], where[better] = now[better], j
        least[i, :n], last[i, :n] = best, where  # the sum of all scores is the same for all cuts
    begins, at, row = [], length.copy(), np.arange(start.size)
    while row.size:
        at[row] = last[at[row], row]
        begins.append(start[row] + at[row])
        row = row[at[row] > 0]
    return np.sort(np.concatenate(begins))


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each range, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if ends.size else 0) + np.repeat(starts - ends + sizes, sizes)


@dataclass(frozen=True)
class Queries:
    """Texts to search for: numbers of their terms with what one unit of score counts (weight x repeats), and how many places each has."""

    terms: dict[bytes, int]
    of: list[tuple[np.ndarray, np.ndarray]]
    top: int
    documents: int
    all_terms: int


class Shard:
    """A shard with its scores and blocks."""

    def __init__(self, row: dict, q: Queries):
        array = lambda c, kind: np.frombuffer(row[c], dtype=kind)
        self.ids, self.has_id, lengths = array("doc_ids", np.int64), array("has_id", bool), array("lengths", np.int64)
        sizes, every = np.array(row["sizes"], dtype=np.int64), array("places", np.int32).astype(np.int64)
        counts = np.frombuffer(row["counts"], dtype=np.int64 if every.size and len(row["counts"]) == 8 * every.size else np.int32).astype(np.int64)
        mine = np.array([q.terms.get(t, -1) for t in row["terms"]], dtype=np.int64)
        begin, some = np.cumsum(sizes) - sizes, np.flatnonzero(mine >= 0)
        at, sizes = ranges(begin[some], sizes[some]), sizes[some]
        self.place, tf = every[at], counts[at]
        m = 100 - 25 + (25 * lengths * q.documents) // max(1, q.all_terms)
        self.score = (1_000_000_000 * tf) // (1000 * tf + 12 * m[self.place])
        self.list_of = np.full(len(q.terms), -1)
        self.list_of[mine[some]] = np.arange(some.size)
        self.start = block_starts(self.score, self.place, sizes)
        self.size = np.diff(np.r_[self.start, self.score.size])
        self.high = np.maximum.reduceat(self.score, self.start) if self.start.size else self.score
        self.first, self.last = self.place[self.start], self.place[self.start + self.size - 1]
        edges = np.r_[0, np.cumsum(sizes)]
        self.blocks = np.searchsorted(self.start, edges)  # of list i: blocks[i] to blocks[i + 1]

    def search(self, terms: np.ndarray, weights: np.ndarray, least: int, top: int) -> tuple[np.ndarray, np.ndarray]:
        """(places of documents, their scores) of those that may be among the first `top`, where a score of less than `least` can't."""
        lists = self.list_of[terms]
        weights, lists = weights[lists >= 0], lists[lists >= 0]
        n_blocks = self.blocks[lists + 1] - self.blocks[lists]
        block, weight = ranges(self.blocks[lists], n_blocks), np.repeat(weights, n_blocks)
        bound = np.zeros(self.ids.size + 1, dtype=np.int64)
        high = weight * self.high[block]
        np.add.at(bound, self.first[block], high)
        np.subtract.at(bound, self.last[block] + 1, high)
        bound = np.cumsum(bound)[:-1]
        rest = np.flatnonzero(bound >= max(1, least))
        rest = rest[np.argsort(-bound[rest], kind="stable")]
        places, scores, step = [], [], 4 * top
        while rest.size:
            taken, rest = np.sort(rest[:step]), rest[step:]
            found = self.exact(taken, block, weight)
            places.append(taken[found >= max(1, least)])
            scores.append(found[found >= max(1, least)])
            if sum(x.size for x in scores) >= top:
                every = np.concatenate(scores)
                least = max(least, int(np.partition(every, every.size - top)[every.size - top]))
            rest, step = rest[bound[rest] >= max(1, least)], 4 * step
        if not places:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        places, scores = np.concatenate(places), np.concatenate(scores)
        return places[scores >= least], scores[scores >= least]

    def exact(self, places: np.ndarray, block: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Scores of some documents (ascending), out of the blocks that reach over one of them."""
        met = np.searchsorted(places, self.last[block], side="right") > np.searchsorted(places, self.first[block])
        block, weight = block[met], weight[met]
        at, weight = ranges(self.start[block], self.size[block]), np.repeat(weight, self.size[block])
        slot = np.searchsorted(places, self.place[at])
        hit = places[np.minimum(slot, places.size - 1)] == self.place[at]
        out = np.zeros(places.size, dtype=np.int64)
        np.add.at(out, slot[hit], weight[hit] * self.score[at[hit]])
        return out


class Best:
    """The first documents so far, for each text."""

    def __init__(self, q: Queries):
        none = np.zeros(0, dtype=np.int64)
        self.q, self.held = q, [(none, none, none)] * len(q.of)

    def take(self, shard: Shard) -> None:
        for i, (terms, weights) in enumerate(self.q.of):
            score, absent, doc = self.held[i]
            least = int(score[-1]) if score.size == self.q.top else 1
            places, scores = shard.search(terms, weights, least, self.q.top)
            if places.size:
                score, absent, doc = np.r_[score, scores], np.r_[absent, ~shard.has_id[places]], np.r_[doc, shard.ids[places]]
                order = np.lexsort((doc, absent, -score))[: self.q.top]
                self.held[i] = score[order], absent[order], doc[order]


def search(index: Index, texts: list[str], top: int = 20) -> DataFrame:
    """(query: number in `texts`, doc_id, score) of the first `top` documents of each text: every one with a score above 0 if fewer.

    Of equal scores the lesser id comes first, rows without an id last. The texts go to every task, so their bytes must be bounded.
    """
    spark = index.shards.sparkSession
    counted = [terms_of(t) for t in texts]
    every = sorted(set().union(*counted))
    df = index.frequencies(every) if every else {}
    n = index.documents
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in every if t in df}
    number = {t: i for i, t in enumerate(weight)}
    of = [(np.array([number[t] for t in c if t in number], dtype=np.int64), np.array([weight[t] * k for t, k in c.items() if t in number], dtype=np.int64)) for c in counted]
    held = spark.sparkContext.broadcast(Queries(number, of, top, n, index.terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(held.value)
        for batch in batches:
            for i in range(batch.num_rows):
                best.take(Shard(batch.slice(i, 1).to_pylist()[0], held.value))
        for i, (score, absent, doc) in enumerate(best.held):
            if score.size:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(score.size, i)), pa.array(doc, mask=absent.astype(bool)), pa.array(score)], names=["query", "doc_id", "score"])

    found = index.shards.select(*(f.split(" ")[0] for f in SHARD.split(", ")[:7])).mapInArrow(run, "query long, doc_id long, score long")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    # tasks may be very many: first of the results of some of them, then of all
    found = found.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64)))
    for by in (("query", "part"), ("query",)):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= top)
    return found.select("query", "rank", "doc_id", "score")


def rank(docs: DataFrame, items: DataFrame, top: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: the first `top` documents for the text of each row of `items`.

    Documents and items without text or terms have no results. Repeated items each have theirs (rank 1 to `top` for each
    row), equal texts are searched for once; repeated documents take a place each. Further columns are ignored. If one of the
    tables is empty, so is the result. Of many items, QUERY_BYTES of text at a time go through the index; it holds the items'
    terms alone if they are TERMS or fewer.
    """
    spark = docs.sparkSession
    texts = cut(items.filter("text is not null").select("text").distinct(), "items")
    n, size = footprint(texts)
    out = spark.createDataFrame([], "text string, rank int, doc_id long, score long")
    if not n:
        return out.select(F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id"), "rank", "doc_id", "score")
    blocks = -(-size // QUERY_BYTES)
    block = lambda i: [t for (t,) in texts.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == i).orderBy("text").collect()]
    first = block(0)
    terms = sorted(set().union(*map(terms_of, first))) if blocks == 1 else None
    index = build_index(docs, terms if terms is not None and len(terms) <= TERMS else None)
    for i in range(blocks):
        some = first if not i else block(i)
        if some:
            named = spark.createDataFrame([(k, t) for k, t in enumerate(some)], "query long, text string")
            found = search(index, some, top).join(F.broadcast(named), "query").select("text", "rank", "doc_id", "score")
            out = out.unionByName(cut(found, "ranked"))
    return items.select("item_id", "text").join(out, "text").select("item_id", "rank", "doc_id", "score")
