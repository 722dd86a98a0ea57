"""Collocations by hashed passes over the corpus (PCY, DHP).

Pass k counts phrases of k words exactly, but only those that can be frequent: both their parts of k - 1 words are (Apriori),
and so is the bucket that the phrase falls into. While it counts, it adds the phrases of k + 1 words whose parts
have passed to a table of bucket counts. Between two passes two bitmaps go to every task, of the frequent phrases of k
words and of the buckets of the next length; their size is a parameter and doesn't grow with the data. A bit that is set
for nothing costs work and never a result, as counts are kept by the words themselves.

Every language is counted by itself. Tasks number the words that they meet and count blocks of the corpus as arrays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratewright.llm.common import CHUNK_BYTES, cut, footprint, hashed64, maybe_broadcast, pieces_of, shared_folder, slices, spare
from ratewright.shared import remove

#: A-Z lower-cased; bytes that end a piece as line ends; the two bytes that mark ends below, which UTF-8 has not, as a third.
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\x0d\xfe\xff", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b"\xfd\xfd")
BREAK = re.compile(rb"[\x20\x09-\x0D.,;:!?]")
PIECE_END, TEXT_END = b"\xff", b"\xfe"

#: Words of a block that is counted at once; distinct words that a task numbers, and distinct phrases that it holds, before it gives
#: out its counts and starts anew.
BLOCK_WORDS, DISTINCT_WORDS, HELD = 500_000, 300_000, 2_000_000

#: Buckets in a row of the table of counts.
ROW = 32_768

#: The odd number that a hash is multiplied with before the next word's is added.
FACTOR = np.uint64(0x9E3779B97F4A7C15)


class Numbers(dict):
    """Word to number, given when it is first asked for. 0 and 1 are ends of pieces and texts."""

    def __init__(self) -> None:
        super().__init__({PIECE_END: 0, TEXT_END: 1})
        self.words, self.hashes = [PIECE_END, TEXT_END], [0, 0]

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.words)
        self.words.append(word)
        self.hashes.append(xxhash.xxh3_64_intdigest(word))
        return n


def has(bits: np.ndarray, hashes: np.ndarray, size: int) -> np.ndarray:
    """Whether the bit of each hash is set, of 2^size."""
    at = hashes >> np.uint64(64 - size)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


@dataclass
class Pass:
    """What a task of pass k needs: the longest phrase, the least count, the two bitmaps (not for k = 1)."""

    k: int
    most: int
    least: int
    size: int
    frequent: np.ndarray | None = None
    buckets: np.ndarray | None = None


class Counter:
    """The counts of one task: blocks of (language, word) numbers go in, batches of rows come out."""

    def __init__(self, p: Pass):
        self.p = p
        self.numbers = Numbers()
        self.langs: dict[str, int] = {}
        self.lang_names: list[str] = []
        self.blocks: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0
        self.table = np.zeros(1 << p.size if p.k < p.most else 0, dtype=np.uint8 if p.least < 256 else np.uint32)
        self.total: dict[int, int] = {}
        self.found: list[np.ndarray] = []
        self.n_found = 0

    def lang(self, name: str) -> int:
        if name not in self.langs:
            self.langs[name] = len(self.lang_names)
            self.lang_names.append(name)
        return self.langs[name]

    def feed(self, texts: list[bytes], langs: list[str], whole: bool = True) -> None:
        """Texts that end, or the first part of one that goes on."""
        joined = (b" " + TEXT_END + b" ").join([t.translate(FOLD) for t in texts]) + (b" " + TEXT_END) * whole
        words = joined.replace(b"\n", b" " + PIECE_END + b" ").split()
        ids = np.fromiter(map(self.numbers.__getitem__, words), dtype=np.int64, count=len(words))
        end = ids == 1
        lang = np.array([self.lang(x) for x in langs], dtype=np.int64)[np.minimum(np.cumsum(end) - end, len(langs) - 1)]
        if self.p.k == 1:
            for i, n in enumerate(np.bincount(lang[ids > 1], minlength=len(self.lang_names)).tolist()):
                self.total[i] = self.total.get(i, 0) + n
        self.blocks.append((lang, ids))
        self.held += ids.size

    def full(self) -> bool:
        return self.held >= BLOCK_WORDS

    def count(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        """Rows of the phrases that begin in what is held; the last k places stay for the next block, as phrases go on from there."""
        p, k = self.p, self.p.k
        if last:
            self.blocks.append((np.zeros(k, dtype=np.int64), np.ones(k, dtype=np.int64)))
        if not self.blocks:
            return
        lang, ids = (np.concatenate(x) for x in zip(*self.blocks, strict=True))
        starts = ids.size - k
        if starts <= 0:
            self.blocks = [(lang, ids)]
            return
        word, live = np.array(self.numbers.hashes, dtype=np.uint64)[ids], ids > 1
        of_lang = np.array([xxhash.xxh3_64_intdigest(x) for x in self.lang_names] or [0], dtype=np.uint64)
        hashes, ok = hashed64(of_lang[lang] * FACTOR + word), live
        for j in range(1, k):
            before = hashes
            hashes, ok = hashed64(before[:-1] * FACTOR + word[j:]), ok[:-1] & live[j:]
        if k > 1:
            at = np.flatnonzero(ok)
            ok[at] = has(p.frequent, before[at], p.size) & has(p.frequent, before[at + 1], p.size) & has(p.buckets, hashes[at], p.size)
        if k < p.most:
            longer = np.flatnonzero(ok[:-1] & ok[1:])
            bucket, n = np.unique((hashed64(hashes[longer] * FACTOR + word[longer + k]) >> np.uint64(64 - p.size)).astype(np.int64), return_counts=True)
            self.table[bucket] = np.minimum(self.table[bucket] + n, np.iinfo(self.table.dtype).max)
        at = np.flatnonzero(ok[:starts])
        self.hold(np.stack([lang[at], *(ids[at + j] for j in range(k)), np.ones(at.size, dtype=np.int64)]).astype(np.int32 if starts < 1 << 31 else np.int64))
        self.blocks, self.held = [(lang[starts:].copy(), ids[starts:].copy())], k
        if last or len(self.numbers) > DISTINCT_WORDS or self.n_found > HELD:
            yield from self.rows()
        if len(self.numbers) > DISTINCT_WORDS:
            words, self.numbers = self.numbers.words, Numbers()
            self.blocks = [(lang[starts:].copy(), np.array([self.numbers[words[i]] for i in ids[starts:].tolist()], dtype=np.int64))]

    def hold(self, new: np.ndarray) -> None:
        """Counts of phrases as rows of language, words and number, equal phrases added up."""
        key, width = new[0].astype(np.int64), len(self.numbers.words).bit_length()
        for column in new[1:-1]:
            if key.size and int(key.max()).bit_length() + width > 62:
                key = np.unique(key, return_inverse=True)[1]
            key = key << width | column
        _, first, of = np.unique(key, return_index=True, return_inverse=True)
        n = np.zeros(first.size, dtype=np.int64)
        np.add.at(n, of, new[-1])
        self.found.append(np.vstack([new[:-1, first], n.astype(new.dtype)]))
        self.n_found += first.size

    def rows(self) -> Iterator[pa.RecordBatch]:
        """(lang, phrase, n) of what is held, in order of the phrases, so that neighbours are alike and take little room."""
        every, self.found, self.n_found = self.found, [], 0
        if len(every) > 1:
            self.hold(np.hstack(every))
            every, self.found, self.n_found = self.found, [], 0
        if not every or not every[0].shape[1]:
            return
        lang, *ids, n = every[0]
        words = pa.array(self.numbers.words, type=pa.binary())
        phrase = pc.binary_join_element_wise(*(words.take(pa.array(c)) for c in ids), pa.scalar(b" ", type=pa.binary()))
        order = pc.sort_indices(phrase)
        names = pa.array(self.lang_names, type=pa.string()).take(pa.array(lang))
        for i in range(0, len(order), 100_000):
            some = order.slice(i, 100_000)
            yield batch(names.take(some), phrase.take(some), np.zeros(len(some), dtype=np.int64), pa.array(n).take(some).cast(pa.int64()))

    def buckets(self) -> Iterator[pa.RecordBatch]:
        """The counts of ROW buckets each (key: which), and the words of each language."""
        if self.total:
            yield batch([self.lang_names[i] for i in self.total], None, np.zeros(len(self.total), dtype=np.int64), np.array([*self.total.values()], dtype=np.int64))
        rows = self.table.reshape(-1, min(ROW, max(1, self.table.size)))
        some = np.flatnonzero(rows.any(axis=1))
        for i in range(0, some.size, 32):
            part = some[i : i + 32]
            yield batch([None] * part.size, None, part, np.zeros(part.size, dtype=np.int64), [rows[j].tobytes() for j in part])


RAW = "lang string, phrase string, key long, n long, counts binary"


def batch(lang: list | pa.Array, phrase: pa.Array | None, key: np.ndarray, n: np.ndarray | pa.Array, counts: list | None = None) -> pa.RecordBatch:
    none = pa.nulls(len(lang), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(lang, type=pa.string()), (none if phrase is None else phrase).cast(pa.string()), pa.array(key, type=pa.int64()), pa.array(n, type=pa.int64()), none if counts is None else pa.array(counts, type=pa.binary())], names=["lang", "phrase", "key", "n", "counts"])


def one_pass(texts: DataFrame, p: Pass) -> tuple[DataFrame, str]:
    """(rows of Counter, where they are written in the shared folder): texts has lang and text."""
    held = texts.sparkSession.sparkContext.broadcast(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(held.value)
        for rows in batches:
            for part in slices(rows):
                langs, own = part.column(0).to_pylist(), pc.cast(part.column(1), pa.binary()).to_pylist()
                if len(own) > 1 or len(own[0]) <= CHUNK_BYTES:
                    counter.feed(own, langs)
                else:
                    for piece in pieces_of(own[0], BREAK):
                        counter.feed([piece], langs, whole=False)
                        if counter.full():
                            yield from counter.count()
                    counter.feed([b""], langs)
                if counter.full():
                    yield from counter.count()
        yield from counter.count(last=True)
        yield from counter.rows()
        yield from counter.buckets()

    path = f"{shared_folder(texts.sparkSession)}/ratewright/phrases-{p.k}-{uuid4().hex}"
    texts.mapInArrow(run, RAW).write.option("compression", "zstd").parquet(path)
    return texts.sparkSession.read.schema(RAW).parquet(path), path


def frequent_buckets(raw: DataFrame, p: Pass) -> np.ndarray:
    """The bitmap of buckets with p.least phrases or more: tasks add up the rows of the table that fall to them."""
    kind, least, most = (np.uint8 if p.least < 256 else np.uint32), p.least, min(ROW, 1 << p.size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for rows in batches:
            for key, counts in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                new = np.frombuffer(counts, dtype=kind)
                old = sums.get(key)
                sums[key] = new if old is None else np.minimum(old.astype(np.int64) + new, np.iinfo(kind).max).astype(kind)
        bits = [np.packbits(x >= least, bitorder="little").tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array([*sums], type=pa.int64()), pa.array(bits, type=pa.binary())], names=["key", "bits"])

    parts = min(64, max(1, (1 << p.size) // ROW))
    rows = raw.filter("counts is not null").select("key", "counts").repartition(parts, "key").mapInArrow(run, "key long, bits binary")
    out = np.zeros((1 << p.size) // 8, dtype=np.uint8)
    for key, bits in rows.collect():  # 2^size bits at most
        out[key * most // 8 : key * most // 8 + len(bits)] = np.frombuffer(bits, dtype=np.uint8)
    return out


def hashes_of(lang: list[str], phrases: list[bytes]) -> np.ndarray:
    """The hashes of phrases of equally many words."""
    digest = lambda xs: np.array([xxhash.xxh3_64_intdigest(x) for x in xs], dtype=np.uint64)
    out = digest(lang)
    for words in zip(*(x.split(b" ") for x in phrases), strict=True):
        out = hashed64(out * FACTOR + digest(words))
    return out


def bitmap_of(phrases: DataFrame, size: int) -> np.ndarray:
    """The bitmap of the hashes of phrases (lang, phrase), by their first `size` bits; 2^size bits are all that the driver gets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if rows.num_rows:
                hashes = hashes_of(rows.column(0).to_pylist(), pc.cast(rows.column(1), pa.binary()).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array((hashes >> np.uint64(64 - size)).astype(np.int64) + 1)], names=["place"])

    place = F.col("place")  # the functions below number bits from 1
    rows = phrases.select("lang", "phrase").mapInArrow(run, "place long").groupBy(F.bitmap_bucket_number(place).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    out = np.zeros(max(ROW, 1 << size) // 8, dtype=np.uint8)
    for b, bits in rows:
        out[(b - 1) * ROW // 8 : b * ROW // 8] = np.frombuffer(bits, dtype=np.uint8)
    return out


def frequent_phrases(docs: DataFrame, most: int = 3, least: int = 10, size: int = 24) -> tuple[DataFrame, DataFrame]:
    """((lang, words, phrase, f) of all phrases of up to `most` words that occur `least` times or more, (lang, n)).

    lang is `und` where null; n counts all word occurrences of a language. 2^size: bits of each bitmap; every task counts
    as many buckets, a byte each. Two bitmaps are broadcast for each pass; 2^24 bits are 2 MB.
    """
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    found, totals, p = [], None, Pass(1, most, least, size)
    for k in range(1, most + 1):
        raw, path = one_pass(texts, p)
        if k == 1:
            totals = cut(raw.filter("phrase is null and counts is null").groupBy("lang").agg(F.sum("n").alias("n")), "totals")
        # a task has given out each phrase once or a few times; dealt in their order, they take less room than sums would that come in any
        dealt = raw.filter("phrase is not null").select("lang", "phrase", "n").repartition("lang", "phrase")
        counted = dealt.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
        found.append(cut(counted.select("lang", F.lit(k).alias("words"), "phrase", "f"), f"frequent-{k}"))
        if k < most:
            p = Pass(k + 1, most, least, size, bitmap_of(found[-1], size), frequent_buckets(raw, p))
        remove(texts.sparkSession, path)  # all that comes of it is written or here
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out, totals


def collocations(docs: DataFrame, most: int = 3, least: int = 10, inside: int = 50, top: int = 2000, size: int = 24) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of 2 to `most` words of each language.

    A phrase that occurs a times (`least` or more) is cut after each of its words; the cut with the lowest score
    floor(1000000 a a / (l r)) counts, the first of those that tie, where its parts occur l and r times. Phrases whose words lie inside a longer
    one that occurs at least `inside` percent as often are dropped. Order: score, a (both falling), bytes of the phrase. Products
    are decimals of 38 digits, so exact for a and l r below 10^16 and 10^38.

    Null texts have no words; null languages count as `und`. Repeated rows count each. Phrases don't reach across the ends
    of pieces or texts. Further columns are ignored. An empty table gives no rows.
    """
    if "lang" not in docs.columns:
        docs = docs.withColumn("lang", F.lit(None).cast("string"))
    f, totals = frequent_phrases(docs.select("lang", "text"), most, least, size)
    parts = f.filter(F.col("words") < most).select("lang", "phrase", "f")
    n, taken = footprint(parts)
    # the parts of frequent phrases are frequent, so all are there; a part that very many phrases share is split by Spark's skew join
    near = lambda df: F.broadcast(df) if n <= 200_000 and taken <= CHUNK_BYTES * 8 else df
    words = F.split("phrase", " ")
    some = lambda a, k: F.array_join(F.slice(words, a, k), " ")
    candidates = f.filter("words > 1")
    cuts = candidates.select("lang", "phrase", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", some(F.lit(1), F.col("k")).alias("first"), some(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    cuts = cuts.join(near(parts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))), ["lang", "first"])
    cuts = cuts.join(near(parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))), ["lang", "rest"])
    big = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumn("above", F.lit(1_000_000).cast("decimal(7,0)") * (big("a") * big("a"))).withColumn("below", big("l") * big("r"))
    scored = cuts.withColumn("score", F.expr("above div below")).groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    longer = candidates.filter("words > 2")
    spots = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.col("words") - k + 1), lambda i: F.array_join(F.slice(words, i, k), " "))))
    covered = longer.select("lang", "f", F.explode(F.array_distinct(spots)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("longest"))
    kept = scored.join(covered, ["lang", "phrase"], "left").filter(F.col("longest").isNull() | (100 * F.col("longest") < inside * F.col("a")))
    rows = kept.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").cast("long").alias("score"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # first in parts of a language, then over what is left of all: no task holds more than `top` rows of each part
    part = spare(rows, "part")
    rows = rows.withColumn(part, F.pmod(F.xxhash64("phrase"), F.lit(64)))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).filter(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return rows.join(maybe_broadcast(totals), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
