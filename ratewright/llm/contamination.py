"""Benchmark decontamination by suffix arrays over shards of the documents.

A shard is a bounded slice of documents. Its words become ids of the benchmark's vocabulary, 0 for others; only
runs of known words can match, so the suffix array holds their positions alone. Every benchmark suffix is then
looked up by binary search: the interval of equal suffixes is narrowed word by word until it is empty, which
gives its longest verbatim match in the shard and, at the window's length, all places where the window stands.
Documents are whole within a shard, so nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratewright.llm.common import cut, slices

#: Text bytes of the benchmark that one pass over the documents searches; a larger one is searched in blocks.
BLOCK_BYTES = 16 << 20

#: A-Z to a-z; digits, letters and bytes of other scripts stay; all else separates words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def fold_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


def suffix_array(tokens: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """`starts`, sorted by the suffix of `tokens` that begins there, as far as `depth` words; by prefix doubling.

    `tokens` must hold 0 wherever a match has to end.
    """
    n = tokens.size
    rank = np.zeros(n + 1, dtype=np.int64)
    rank[:n] = tokens
    known = 1
    while known < depth:
        ahead = np.minimum(np.arange(n) + known, n)
        key = rank[:n] * (int(rank.max()) + 1) + rank[ahead]
        key[tokens == 0] = 0
        rank[:n] = np.unique(key, return_inverse=True)[1] + (0 if (key == 0).any() else 1)
        known *= 2
    return starts[np.argsort(rank[starts], kind="stable")]


class Items:
    """The benchmark as ids: vocabulary, suffixes, and the distinct windows that start at them."""

    def __init__(self, items: list[tuple[object, str | None]], window: int):
        self.window = window
        self.names: list[str | None] = []
        words, self.vocabulary, lengths = [], {}, []
        for name, text in items:
            if own := fold_words(text):
                self.names.append(None if name is None else str(name))
                words.append([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in own])
                lengths.append(len(own))
        self.least = min([window, *lengths])
        self.tokens = np.array([t for w in words for t in (*w, 0)], dtype=np.int64)
        ends = np.cumsum(np.array(lengths, dtype=np.int64) + 1) - 1 if lengths else np.zeros(0, dtype=np.int64)
        item = np.repeat(np.arange(len(lengths)), lengths)
        self.starts = np.flatnonzero(self.tokens)
        left = ends[item] - self.starts if len(lengths) else np.zeros(0, dtype=np.int64)
        size = np.minimum(window, np.array(lengths, dtype=np.int64))[item] if len(lengths) else left
        whole = left >= size  # else the suffix is shorter than a window and serves for longest matches only
        self.size, self.item = np.where(whole, size, 0), item

    def runs(self, tokens: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the runs of `least` known words or more, each followed by a 0; where each id stands in the shard)."""
        known = tokens > 0
        edge = np.flatnonzero(np.diff(np.r_[False, known, False]))
        run_start, run_end = edge[::2], edge[1::2]
        long = run_end - run_start >= least
        keep = np.zeros(tokens.size + 1, dtype=np.int64)
        np.add.at(keep, run_start[long], 1)
        np.add.at(keep, run_end[long], -1)
        inside = np.flatnonzero(np.cumsum(keep[:-1]) > 0)
        sizes = (run_end - run_start)[long]
        at = np.arange(sizes.sum() + sizes.size)
        gap = np.cumsum(sizes + 1) - 1
        compact = np.zeros(at.size, dtype=np.int64)
        body = np.ones(at.size, dtype=bool)
        body[gap] = False
        compact[body] = tokens[inside]
        place = np.zeros(at.size, dtype=np.int64)
        place[body] = inside
        return compact, place

    def longest(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(length, place in the shard) of the longest verbatim match of each benchmark suffix; length 0 without one.

        The suffixes of the shard are sorted as far as its longest run of known words goes, or the longest item.
        """
        compact, place = self.runs(tokens, 1)
        length, at = np.zeros(self.starts.size, dtype=np.int64), np.full(self.starts.size, -1, dtype=np.int64)
        if not compact.size or not self.starts.size:
            return length, at
        gap = np.flatnonzero(np.r_[compact == 0])
        most = int(min(np.diff(np.r_[-1, gap]).max(), np.diff(np.r_[-1, np.flatnonzero(self.tokens == 0)]).max()))
        order = suffix_array(compact, np.flatnonzero(compact), most)
        compact = np.r_[compact, np.zeros(1, dtype=np.int64)]
        low, high = np.zeros(self.starts.size, dtype=np.int64), np.full(self.starts.size, order.size)
        live, depth = np.arange(self.starts.size), 0
        while live.size:
            want = self.tokens[self.starts[live] + depth]
            first = self.bisect(compact, order, low[live], high[live], depth, want, False)
            last = self.bisect(compact, order, low[live], high[live], depth, want, True)
            on = (last > first) & (want > 0)
            live, depth = live[on], depth + 1
            low[live], high[live], length[live] = first[on], last[on], depth
        some = length > 0
        # the first place of each interval of equal suffixes
        stands = np.r_[place[order], np.iinfo(np.int64).max]
        at[some] = np.minimum.reduceat(stands, np.stack([low[some], high[some]], axis=1).ravel())[::2] if some.any() else at[some]
        return length, at

    def search(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Every window match: its place in the shard, the benchmark suffix, the window's length, and how far the match goes.

        tokens: a shard's ids with 0 between documents and for unknown words.
        """
        compact, place = self.runs(tokens, self.least)
        none = np.zeros(0, dtype=np.int64)
        if not compact.size or not self.starts.size:
            return none, none, none, none
        order = suffix_array(compact, np.flatnonzero(compact), max(self.window, 1))
        compact = np.r_[compact, np.zeros(1, dtype=np.int64)]
        low, high = np.zeros(self.starts.size, dtype=np.int64), np.full(self.starts.size, order.size)
        live = np.arange(self.starts.size)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        depth = 0
        while live.size and depth < self.window:
            want = self.tokens[self.starts[live] + depth]
            low[live] = self.bisect(compact, order, low[live], high[live], depth, want, False)
            high[live] = self.bisect(compact, order, low[live], high[live], depth, want, True)
            live = live[(high[live] > low[live]) & (want > 0)]
            depth += 1
            if (whole := live[self.size[live] == depth]).size:
                wide = high[whole] - low[whole]
                pos = order[np.repeat(low[whole] - np.r_[0, np.cumsum(wide)[:-1]], wide) + np.arange(wide.sum())]
                found.append((pos, np.repeat(whole, wide), np.full(pos.size, depth)))
        if not found:
            return none, none, none, none
        pos, suffix, size = (np.concatenate(x) for x in zip(*found, strict=True))
        # the array is sorted as far as a window goes: beyond it each match is followed word by word
        reach, on = size.copy(), np.arange(size.size)
        while on.size:
            ours, theirs = self.tokens[self.starts[suffix[on]] + reach[on]], compact[pos[on] + reach[on]]
            on = on[(ours == theirs) & (ours > 0)]
            reach[on] += 1
        return place[pos], suffix, size, reach

    @staticmethod
    def bisect(tokens: np.ndarray, order: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int, want: np.ndarray, right: bool) -> np.ndarray:
        """For each query the first place in order[low:high] whose word at `depth` isn't below (right: is above) `want`."""
        low, high = low.copy(), high.copy()
        while (open_ := low < high).any():
            mid = (low + high) // 2
            word = tokens[np.minimum(order[np.minimum(mid, order.size - 1)] + depth, tokens.size - 1)]
            go = open_ & ((word <= want) if right else (word < want))
            low = np.where(go, mid + 1, low)
            high = np.where(open_ & ~go, mid, high)
        return low


#: What the passes over the documents add to their rows, after a mark that no column of theirs begins with.
FOUND = "n_words long, spans array<bigint>, found array<string>, longest long, longest_at long, longest_item string"
NAMES = [f.split()[0] for f in FOUND.split(", ")]


def mark_of(docs: DataFrame) -> str:
    mark = "__"
    while any(c.startswith(mark) for c in docs.columns):
        mark += "_"
    return mark


def with_hits(docs: DataFrame, items: list[tuple[object, str | None]], window: int, text: str, mark: str, again: bool) -> DataFrame:
    """`docs` with FOUND: spans are starts and ends of hit words by turns, merged; found are item ids, null last.

    `again`: another block of the benchmark has added them already, and this block's matches join its own.
    """
    bench = docs.sparkSession.sparkContext.broadcast(Items(items, window))
    added = [mark + n for n in NAMES]
    names = [c for c in docs.columns if c not in added]
    at = docs.columns.index(text)
    schema = docs.select(*names).schema
    for f in T._parse_datatype_string(FOUND).fields:
        schema = schema.add(mark + f.name, f.dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = bench.value
        known = b.vocabulary.get
        for batch in batches:
            for part in slices(batch, text):
                words = [fold_words(t) for t in part.column(at).to_pylist()]
                n = np.array([len(w) for w in words], dtype=np.int64)
                first = np.cumsum(n + 1) - n - 1
                tokens = np.fromiter((known(w, 0) for own in words for w in (*own, b"")), dtype=np.int64, count=int(n.sum()) + n.size)
                place, suffix, size, reach = b.search(tokens)
                spans, found, longest, longest_at, longest_item = [part.column(part.schema.get_field_index(c)).to_pylist() for c in added[1:]] if again else [[[] for _ in words], [[] for _ in words], [0] * len(words), [None] * len(words), [None] * len(words)]
                new: list[list[tuple[int, int]]] = [[] for _ in words]
                order = np.lexsort((suffix, -reach, place))
                doc = np.searchsorted(first, place, side="right") - 1
                for d, p, s, x, r in zip(*(v[order].tolist() for v in (doc, place - first[doc], suffix, size, reach)), strict=True):
                    new[d].append((p, p + x))
                    found[d].append(b.names[b.item[s]])
                    # longer, or as long and earlier in the text
                    if r > longest[d] or (r == longest[d] and p < longest_at[d]):
                        longest[d], longest_at[d], longest_item[d] = r, p, b.names[b.item[s]]
                for d, own in enumerate(new):
                    if own:
                        spans[d] = merged(sorted([*zip(spans[d][::2], spans[d][1::2], strict=True), *own]))
                        found[d] = sorted({*found[d]}, key=lambda x: (x is None, x or ""))
                kept = [part.column(part.schema.get_field_index(c)) for c in names]
                more = [pa.array(n), pa.array(spans, type=pa.list_(pa.int64())), pa.array(found, type=pa.list_(pa.string())), pa.array(longest, type=pa.int64()), pa.array(longest_at, type=pa.int64()), pa.array(longest_item, type=pa.string())]
                yield pa.RecordBatch.from_arrays([*kept, *more], names=[*names, *added])

    return docs.mapInArrow(run, schema)


def longest_matches(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id (as text), word, length, doc_id, at: for each word of the benchmark the longest verbatim match of the suffix
    that begins there, in words, with the document and the word where it stands.

    Each task keeps the longest match of each suffix over all its shards; those meet by suffix. Of equally long ones
    that of the least document id counts, nulls last, and there the first. Suffixes without any match give no row,
    nor do items without an id or words; repeated items give a row for each distinct text. Texts as in
    `find_contamination`.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = None
    for block in blocks(benchmark, block_bytes):
        bench = docs.sparkSession.sparkContext.broadcast(Items([x for x in block if x[0] is not None], 1))

        def run(batches: Iterator[pa.RecordBatch], bench: object = bench) -> Iterator[pa.RecordBatch]:
            b = bench.value
            best, where = np.zeros(b.starts.size, dtype=np.int64), {}
            for batch in batches:
                for part in slices(batch):
                    ids = part.column(0).to_pylist()
                    words = [fold_words(t) for t in part.column(1).to_pylist()]
                    n = np.array([len(w) for w in words], dtype=np.int64)
                    rank = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))  # as ties go
                    first = np.r_[0, np.cumsum(n[rank] + 1)]
                    tokens = np.fromiter((b.vocabulary.get(w, 0) for i in rank for w in (*words[i], b"")), dtype=np.int64, count=int(first[-1]))
                    length, at = b.longest(tokens)
                    better = np.flatnonzero((length >= best) & (length > 0))
                    doc = np.searchsorted(first, at[better], side="right") - 1
                    for s, d, a in zip(better.tolist(), doc.tolist(), (at[better] - first[doc]).tolist(), strict=True):
                        one = ids[rank[d]]
                        key = (one is None, one or 0, a)
                        if length[s] > best[s] or key < where[s][0]:
                            best[s], where[s] = length[s], (key, one, a)
            if where:
                begin = np.r_[0, np.flatnonzero(b.tokens == 0) + 1]
                rows = [(b.names[b.item[s]], int(b.starts[s] - begin[b.item[s]]), int(best[s]), d, int(a)) for s, (_, d, a) in where.items()]
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), batch.schema.field(0).type, pa.int64()), strict=True)], names=["item_id", "word", "length", "doc_id", "at"])

        found = docs.select("doc_id", "text").mapInArrow(run, f"item_id string, word long, length long, doc_id {kind}, at long")
        out = found if out is None else out.unionByName(found)
    best = F.min_by(F.struct("length", "doc_id", "at"), F.struct((-F.col("length")).alias("l"), F.col("doc_id").isNull().alias("n"), "doc_id", "at"))
    return out.groupBy("item_id", "word").agg(best.alias("b")).select("item_id", "word", "b.*")


def merged(spans: list[tuple[int, int]]) -> list[int]:
    """Sorted spans, overlapping and touching ones joined, as starts and ends by turns."""
    out: list[int] = []
    for a, b in spans:
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def blocks(benchmark: DataFrame, most: int) -> Iterator[list[tuple[object, str | None]]]:
    """The items, in lists of at most `most` text bytes (or one item), by item_id as text."""
    block: list[tuple[object, str | None]] = []
    held = 0
    for row in benchmark.select("item_id", "text").orderBy(F.col("item_id").cast("string"), "text").toLocalIterator():
        size = len((row[1] or "").encode())
        if block and held + size > most:
            yield block
            block, held = [], 0
        block.append((row[0], row[1]))
        held += size
    yield block


def judge_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, block_bytes: int = BLOCK_BYTES, text: str = "text") -> tuple[DataFrame, str]:
    """`docs` with n_words, n_hit, contaminated and what `with_hits` adds, all after a mark; and that mark.

    A benchmark beyond `block_bytes` is searched block by block: each block is a pass of its own over the rows, and what it
    found is written before the next, so that no task holds more of the benchmark than that.
    """
    mark, again = mark_of(docs), False
    for block in blocks(benchmark, block_bytes):
        docs = with_hits(cut(docs, "contamination") if again else docs, block, window, text, mark, again)
        again = True
    spans, n_hit = f"{mark}spans", f"{mark}n_hit"
    hit = F.when(F.size(spans) > 0, F.expr(f"aggregate(sequence(0, size({spans}) div 2 - 1), 0L, (acc, k) -> acc + {spans}[2 * k + 1] - {spans}[2 * k])")).otherwise(F.lit(0)).cast("long")
    docs = docs.withColumn(n_hit, hit)
    return docs.withColumn(f"{mark}contaminated", (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(f"{mark}n_words"))), mark


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated; longest, longest_at, longest_item: the longest
    verbatim match that holds a window, in words, where it starts, and in which item (0 and nulls without one).

    Every input row gives a row. Null and empty texts have no words, hits or items and are clean; items without
    words match nothing; items below `window` words are one window of their own length; items that share a
    window all count, repeated item ids once. Of equally long matches the first in the text is given. An empty
    benchmark hits nothing, an empty table gives no rows, further columns are ignored. Nothing is shuffled.
    """
    found, mark = judge_contamination(docs.select("doc_id", "text"), benchmark, window, block_bytes)
    of = lambda c: F.col(mark + c)
    return found.select(
        "doc_id", of("n_words").alias("n_words"), of("n_hit").alias("n_hit"), F.size(of("found")).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", of("found")), 256).alias("items_sha256"),
        of("contaminated").alias("contaminated"), of("longest").alias("longest"), of("longest_at").alias("longest_at"), of("longest_item").alias("longest_item"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, block_bytes: int = BLOCK_BYTES, text: str = "text") -> DataFrame:
    """The rows of `docs` that aren't contaminated, with all their own columns and no others."""
    found, mark = judge_contamination(docs, benchmark, window, block_bytes, text)
    return found.filter(~F.col(f"{mark}contaminated")).select(*docs.columns)


def digest(names: list[str]) -> str:
    """items_sha256 of a list of item ids, for tests."""
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
