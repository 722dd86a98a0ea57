"""Scores by prediction by partial matching: a byte-context trie with escapes (method C) and symbol exclusion.

A position of a text is described by its sequence: the byte and up to ORDER bytes before it. The trie is the
table of all distinct sequences with how often training texts hold them; a sequence's code length follows from
the counts of its suffixes alone, so it is computed once for each distinct sequence, and a text's score is the
sum over its positions. Sequences with the same last two context bytes share a task; the two short orders are
tables of at most 65,536 + 256 entries. Word scores use the same two steps: count, then sum over the text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewright.llm.common import collected, cut, slices

#: Bytes of context. Sequences have one byte more and must fit a signed 64-bit key with their length.
ORDER = 4

#: Entries of a value table that every task holds; the rest is joined, so this bounds memory and changes no score.
HEAD_SEQUENCES, HEAD_WORDS = 400_000, 200_000

#: Distinct words a worker gathers before it hands their counts on.
GATHER_WORDS = 300_000

#: Text bytes a step holds at once: each takes about 60 bytes of arrays.
STEP_BYTES = 1 << 20

SHIFT = np.uint64(8)


def sequences(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(key of each position, index of its text). A key holds the bytes, and their number above them."""
    n = np.array([len(t) for t in texts], dtype=np.int64)
    flat = np.frombuffer(b"".join(texts), dtype=np.uint8).astype(np.uint64)
    text = np.repeat(np.arange(n.size), n)
    into = np.arange(flat.size) - np.repeat(np.cumsum(n) - n, n)
    key = flat.copy()
    for k in range(1, order + 1):
        key[k:] |= np.where(into[k:] >= k, flat[:-k] << np.uint64(8 * k), np.uint64(0))
    return key | ((np.minimum(into, order) + 1).astype(np.uint64) << np.uint64(56)), text


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


class Trie:
    """Counts of the two short orders, which every task needs: whole tables, of bounded size."""

    def __init__(self, pair_keys: np.ndarray, pair_counts: np.ndarray, single_counts: np.ndarray):
        self.single = single_counts  # 256: how often each byte stands anywhere
        self.pair = np.zeros(65_536, dtype=np.int64)  # previous byte, byte
        self.pair[pair_keys] = pair_counts

    def code_lengths(self, keys: np.ndarray, counts: np.ndarray, order: int = ORDER) -> np.ndarray:
        """log10 probability of each sequence's last byte after the others.

        keys: distinct; all sequences whose last two context bytes are those of one given (or that have fewer
        context bytes). counts: in training texts; 0 for sequences that only other texts hold.
        """
        size = (keys >> np.uint64(56)).astype(np.int64)
        out = np.zeros(keys.size)
        going = np.ones(keys.size, dtype=bool)
        symbol = keys & np.uint64(255)
        # what the context above holds, at the level below: sums over its symbols of the shorter context's counts
        drop_n, drop_d = np.zeros(keys.size), np.zeros(keys.size)
        for level in range(order, -1, -1):
            there = size > level
            mask = np.uint64((1 << (8 * (level + 1))) - 1)
            own = keys & mask
            if level >= 2:
                gram, of, n = self.summed(own[there], counts[there])
                context, at = np.unique(gram >> SHIFT, return_inverse=True)
                total = np.bincount(at, weights=n, minlength=context.size)
                kinds = np.bincount(at, weights=n > 0, minlength=context.size)
                n_own, t_own, d_own = np.zeros(keys.size), np.zeros(keys.size), np.zeros(keys.size)
                n_own[there], t_own[there], d_own[there] = n[of], total[at[of]], kinds[at[of]]
            elif level == 1:
                n_own = self.pair[own.astype(np.int64) & 65_535] * there
                rows = self.pair.reshape(256, 256)
                previous = ((own >> SHIFT) & np.uint64(255)).astype(np.int64)
                t_own, d_own = rows.sum(axis=1)[previous] * there, (rows > 0).sum(axis=1)[previous] * there
            else:
                n_own = self.single[symbol.astype(np.int64)]
                t_own, d_own = np.full(keys.size, self.single.sum()), np.full(keys.size, (self.single > 0).sum())
            open_, kinds_left = t_own - drop_n, d_own - drop_d
            seen = there & (t_own > 0)
            whole = open_ + kinds_left
            hit = going & seen & (n_own > 0)
            out[hit] += np.log10(n_own[hit] / whole[hit])
            going &= ~hit
            escape = going & seen & (kinds_left > 0)
            out[escape] += np.log10(kinds_left[escape] / whole[escape])
            # symbols seen here are excluded below: their counts after the shorter context
            if level:
                drop_d = np.where(seen, d_own, 0)
                drop_n = np.where(seen, self.below(own, there, counts, level), 0)
        left = 256 - (self.single > 0).sum()
        out[going] -= np.log10(left) if left else 0.0
        return out

    @staticmethod
    def summed(own: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        gram, of = np.unique(own, return_inverse=True)
        return gram, of, np.bincount(of, weights=counts, minlength=gram.size)

    def below(self, own: np.ndarray, there: np.ndarray, counts: np.ndarray, level: int) -> np.ndarray:
        """For each sequence: the counts that its context's symbols at `level` have after the context of one byte less."""
        out = np.zeros(own.size)
        if level == 1:
            rows = self.pair.reshape(256, 256) > 0
            out[there] = (rows * self.single).sum(axis=1)[((own[there] >> SHIFT) & np.uint64(255)).astype(np.int64)]
            return out
        gram, of, n = self.summed(own[there], counts[there])
        shorter = gram & np.uint64((1 << (8 * level)) - 1)
        if level == 2:
            after = self.pair[shorter.astype(np.int64)].astype(np.float64)
        else:
            # all sequences that end alike are here, longer ones and those at a text's start
            every, m = self.every[level - 1]
            after = m[np.searchsorted(every, shorter)]
        context, at = np.unique(gram >> SHIFT, return_inverse=True)
        out[there] = np.bincount(at, weights=after * (n > 0), minlength=context.size)[at[of]]
        return out

    def prepared(self, keys: np.ndarray, counts: np.ndarray, order: int = ORDER) -> Trie:
        """The counts of all suffixes of the given sequences, by level, for `below`."""
        size = (keys >> np.uint64(56)).astype(np.int64)
        self.every = {}
        for level in range(2, order):
            there = size > level
            gram, _, n = self.summed(keys[there] & np.uint64((1 << (8 * (level + 1))) - 1), counts[there])
            self.every[level] = (gram, n)
        return self


def counted(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(seq, word, n, m): how often training rows (n) and all rows (m) hold each sequence or word, added up per worker.

    docs: text, train (boolean). One pass; workers hand on what they gathered whenever it is a bounded amount.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trained, other = Counter(), Counter()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def out_words() -> pa.RecordBatch:
            names = [*trained, *(w for w in other if w not in trained)]
            n = np.array([trained[w] for w in names], dtype=np.int64)
            m = n + np.array([other[w] for w in names], dtype=np.int64)
            got = pa.RecordBatch.from_arrays([pa.nulls(len(names), pa.int64()), pa.array(names, type=pa.binary()).cast(pa.string()), pa.array(n), pa.array(m)], names=["seq", "word", "n", "m"])
            trained.clear()
            other.clear()
            return got

        for batch in batches:
            for part in slices(batch, most=STEP_BYTES):
                texts = [(t or "").encode() for t in part.column(0).to_pylist()]
                train = part.column(1).to_pylist()
                for t, use in zip(texts, train, strict=True):
                    (trained if use else other).update(words_of(t))
                if len(trained) + len(other) > GATHER_WORDS:
                    yield out_words()
                key, text = sequences(texts, order)
                use = np.array(train, dtype=bool)[text]
                for mine, is_train in ((key[use], True), (key[~use], False)):
                    mine.sort()
                    first = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]]) if mine.size else np.zeros(0, dtype=np.int64)
                    n = np.diff(np.r_[first, mine.size])
                    held.append((mine[first], n if is_train else np.zeros_like(n), n))
                if sum(h[0].size for h in held) > 2_000_000:
                    held[:] = [fold(held)]
                    if held[0][0].size > 1_000_000:
                        yield from sequence_batches(held.pop())
        if trained or other:
            yield out_words()
        if held:
            yield from sequence_batches(fold(held))

    return docs.select("text", "train").mapInArrow(run, "seq long, word string, n long, m long")


def fold(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of the same sequences, added."""
    key, n, m = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if key.size else np.zeros(0, dtype=np.int64)
    add = lambda v: np.add.reduceat(v[order], first) if key.size else v
    return key[first], add(n), add(m)


def sequence_batches(found: tuple[np.ndarray, np.ndarray, np.ndarray], rows: int = 100_000) -> Iterator[pa.RecordBatch]:
    key, n, m = found
    for a in range(0, key.size, rows):
        b = slice(a, a + rows)
        size = key[b].size
        yield pa.RecordBatch.from_arrays([pa.array(key[b].astype(np.int64)), pa.nulls(size, pa.string()), pa.array(n[b].astype(np.int64)), pa.array(m[b].astype(np.int64))], names=["seq", "word", "n", "m"])


def sequence_values(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(seq, value, m) from (seq, n, m): the code length of every sequence, as log10 probability."""
    last = counts.filter("n > 0")
    # bitwise, as the keys hold bytes: the last two bytes, or one where a text starts
    short = last.select(F.col("seq").bitwiseAND(65_535).cast("int").alias("pair"), (F.shiftrightunsigned("seq", 56) > 1).alias("long"), "n").groupBy("pair", "long").agg(F.sum("n").alias("n"))
    table = collected(short)
    pair, long, n = (table.column(c).to_numpy(zero_copy_only=False) for c in ("pair", "long", "n"))
    long = long.astype(bool)
    trie = counts.sparkSession.sparkContext.broadcast(Trie(pair[long].astype(np.int64), n[long].astype(np.int64), np.bincount(pair.astype(np.int64) & 255, weights=n, minlength=256).astype(np.int64)))
    # the last two bytes of the context; sequences with less context depend on the short orders alone
    near = F.when(F.shiftrightunsigned("seq", 56) > 2, F.shiftright("seq", 8).bitwiseAND(65_535)).otherwise(F.lit(-1))
    placed = counts.withColumn("near", near.cast("int")).repartition("near")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        t = pa.Table.from_batches(rows)
        keys, n, m = (t.column(c).to_numpy().astype(np.uint64 if c == "seq" else np.int64) for c in ("seq", "n", "m"))
        value = trie.value.prepared(keys, n, order).code_lengths(keys, n, order)
        yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(value), pa.array(m)], names=["seq", "value", "m"])

    return placed.select("seq", "n", "m").mapInArrow(run, "seq long, value double, m long")


def head_of(values: DataFrame, by: Column, most: int) -> DataFrame:
    """The rows of the largest `by`, at most `most`: a threshold found from a histogram of `by` by powers of 2^(1/8)."""
    step = F.floor(F.log2(by.cast("double")) * 8).cast("int")
    steps = sorted(((r[0], r[1]) for r in values.groupBy(step.alias("s")).count().collect()), reverse=True)  # a few hundred rows at most
    total, least = 0, None
    for s, n in steps:
        if total + n > most:
            break
        total, least = total + n, s
    return values.filter(step >= least) if least is not None else values.limit(0)


def score_texts(docs: DataFrame, order: int = ORDER, head_sequences: int = HEAD_SEQUENCES, head_words: int = HEAD_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of `docs` (doc_id, text, train).

    base_score: words and one end, by add-one counts of training rows. score: log10 probability of the text's
    bytes under the trie of all training rows. Null texts count as empty: 1 token (the end), score 0. Without
    training rows every word is unknown and every byte has probability 1/256. Repeated rows each count and each
    give a row. Rows are told apart by their order in a written table, so ids may be null or repeated.
    """
    spark = docs.sparkSession
    counts = cut(counted(docs, order), "lm-counts")
    seqs = cut(counts.filter(F.col("seq").isNotNull()).groupBy("seq").agg(F.sum("n").alias("n"), F.sum("m").alias("m")), "lm-sequences")
    words = cut(counts.filter(F.col("word").isNotNull()).groupBy("word").agg(F.sum("n").alias("n"), F.sum("m").alias("m")), "lm-words")
    ends = docs.filter("train").count()
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    total, distinct = total + ends, distinct + (1 if ends else 0)
    values = cut(sequence_values(seqs, order), "lm-values")
    head_s = collected(head_of(values, F.col("m"), head_sequences).select("seq", "value"))
    head_w = collected(head_of(words, F.col("m"), head_words).select("word", "n"))
    key = head_s.column("seq").to_numpy().astype(np.uint64)
    by = np.argsort(key)
    shared = spark.sparkContext.broadcast((key[by], head_s.column("value").to_numpy()[by], dict(zip(head_w.column("word").cast(pa.binary()).to_pylist(), head_w.column("n").to_pylist(), strict=True))))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head_key, head_value, head_n = shared.value
        last = max(head_key.size - 1, 0)
        log = {n: float(np.log10(n + 1)) for n in {*head_n.values()}}
        own = uuid4().int >> 65  # rows of one task attempt; only what is written counts
        number = 0
        for batch in batches:
            for part in slices(batch, most=STEP_BYTES):
                texts = [(t or "").encode() for t in part.column(1).to_pylist()]
                key, text = sequences(texts, order)
                distinct_keys = np.unique(key)
                where = np.searchsorted(distinct_keys, key)
                at = np.minimum(np.searchsorted(head_key, distinct_keys), last)
                known = (head_key[at] == distinct_keys) if head_key.size else np.zeros(distinct_keys.size, dtype=bool)
                value = np.where(known, head_value[at], 0.0) if head_key.size else np.zeros(distinct_keys.size)
                score = np.bincount(text, weights=value[where], minlength=len(texts))
                rows_word, rows_word_text = [], []
                rest = np.flatnonzero(~known[where])
                rows_key, rows_text = key[rest].astype(np.int64), text[rest]
                n_tokens, n_known, base = [], [], []
                for i, t in enumerate(texts):
                    ws = words_of(t)
                    got = list(map(head_n.get, ws))
                    n_tokens.append(len(ws) + 1)
                    if None in got:
                        rows_word += [w for w, g in zip(ws, got, strict=True) if g is None]
                        rows_word_text += [i] * got.count(None)
                        got = [g for g in got if g is not None]
                    n_known.append(len(got) - got.count(0))
                    base.append(sum(map(log.__getitem__, got)))
                row = number + np.arange(len(texts))
                number += len(texts)
                yield packed(own, row, part.column(0), part.column(2), n_tokens, n_known, base, score, None, None)
                if rows_text.size:
                    yield packed(own, row[rows_text], None, None, None, None, None, None, rows_key, None, part.schema.field(0).type)
                if rows_word:
                    yield packed(own, row[np.array(rows_word_text)], None, None, None, None, None, None, None, rows_word, part.schema.field(0).type)

    columns = f"part long, row long, doc_id {kind}, train boolean, n_tokens long, n_known long, base double, score double, seq long, word string"
    seen = cut(docs.select("doc_id", "text", "train").mapInArrow(run, columns), "lm-scores")
    rows = seen.filter(F.col("n_tokens").isNotNull())
    # the rare: one row for each text and sequence or word, joined to their values
    rare = seen.filter(F.col("seq").isNotNull()).groupBy("part", "row", "seq").agg(F.count("*").alias("k")).join(values.select("seq", "value"), "seq").groupBy("part", "row").agg(F.sum(F.col("k") * F.col("value")).alias("rare_score"))
    rare_w = seen.filter(F.col("word").isNotNull()).groupBy("part", "row", "word").agg(F.count("*").alias("k")).join(words.select("word", "n"), "word").groupBy("part", "row").agg(F.sum(F.col("k") * F.log10(F.col("n") + 1)).alias("rare_base"), F.sum(F.when(F.col("n") > 0, F.col("k")).otherwise(0)).alias("rare_known"))
    full = rows.join(rare, ["part", "row"], "left").join(rare_w, ["part", "row"], "left")
    zero = F.lit(0.0)
    end_known = 1 if ends else 0
    base = F.col("base") + F.coalesce("rare_base", zero) + float(np.log10(ends + 1)) - F.col("n_tokens") * float(np.log10(total + distinct + 1))
    return full.select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0)) + end_known).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        base.alias("base_score"), (F.col("score") + F.coalesce("rare_score", zero)).alias("score"),
    )


def packed(own: int, row: np.ndarray, doc_id, train, n_tokens, n_known, base, score, seq, word, kind=None) -> pa.RecordBatch:  # noqa: ANN001
    """A batch of the rows that the scoring pass writes; None: nulls."""
    n = len(row)
    of = lambda v, t: pa.nulls(n, t) if v is None else v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v, type=t)
    words = pa.nulls(n, pa.string()) if word is None else pa.array(word, type=pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([
        pa.array(np.full(n, own, dtype=np.int64)), pa.array(np.asarray(row, dtype=np.int64)), of(doc_id, kind), of(train, pa.bool_()), of(n_tokens, pa.int64()), of(n_known, pa.int64()), of(base, pa.float64()), of(score, pa.float64()), of(seq, pa.int64()), words,
    ], names=["part", "row", "doc_id", "train", "n_tokens", "n_known", "base", "score", "seq", "word"])
