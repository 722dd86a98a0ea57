"""N-gram Jaccard join with a token-group matrix.

Texts are sets of shingles; documents of equal sets form a class, and classes are joined. The steps:

1. Each class shows a prefix of its set: so many shingles that two sets within the threshold must share one. The
   order puts shingles that many texts hold last, then goes by hash; any order keeps the join whole.
2. Shingles meet in buckets, as arrays. Classes that share one are linked to the least of them (as many rows as
   classes), and those links are verified. Two rounds with a few other centers follow for what still lies apart.
   Shingles of very many texts are dealt by class instead: each part has a least class, and those meet in turn.
3. What is still open is partitioned into groups of some GROUP_MOST similar classes, linked or not: those that show
   the same widely held shingle, or belong to one large component. The matrix lists the groups whose union of
   prefixes holds a shingle. A class and a group that share fewer shingles than the threshold needs at least are
   dropped by that bound, as is a group of the class's own component; the other groups are opened, and the class
   compared with each member of another component: by what both show of their prefixes, and then as whole sets.
4. Components of all verified links. Every pair of classes that may be similar is either inside a component
   already or compared in step 3, so no link between two components is lost.

Classes are known by 64 bits of their set; sets that agree in those only are told apart by 64 more and renamed.
Comparisons use whole sets, which are made once for each class that is compared, and kept by class.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewright.llm.common import collected, cut, hashed64, maybe_broadcast, slices, tidy

#: Words of a shingle, and the threshold as a fraction.
SHINGLE, SIMILAR = 5, (3, 4)

#: Shingles that are put last, at most: only their order depends on it. Prefix shingles of a bucket; members of a
#: group; classes that are compared with one group in one task.
COMMON_MOST, BUCKET_TOKENS, GROUP_MOST, OPENED_MOST = 300_000, 1_000_000, 64, 128

#: Texts that hold a shingle from which it is dealt by class, not by itself.
HOT_HELD = 20_000

#: Sets that agree in 64 bits only, at most: some three are expected among 10^10.
RENAMED_MOST = 100_000

#: Further rounds of stars, and classes that a class is compared with in each.
STAR_ROUNDS, STAR_CENTERS = 2, 4

#: Links that one task contracts.
FOREST_EDGES = 1_000_000

#: Words whose hashes a worker remembers; distinct shingles it gathers before it looks for common ones.
REMEMBERED, GATHER_TOKENS = 100_000, 1_000_000


class Hashes(dict):
    """Word to 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingle_sets(texts: list[str | None], hashes: Hashes, k: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer than `k` words are one shingle, none give none."""
    if len(hashes) > REMEMBERED:
        hashes.clear()
    words = [(t or "").encode().lower().split() for t in texts]
    n = np.array([len(w) for w in words], dtype=np.int64)
    flat = np.fromiter((hashes[w] for own in words for w in own), dtype=np.uint64, count=int(n.sum()))
    base = np.uint64(0xD6E8FEB86659FD93)
    rolled = np.zeros(flat.size, dtype=np.uint64)
    if flat.size >= k:
        h = np.zeros(flat.size - k + 1, dtype=np.uint64)
        for i in range(k):
            h = h * base + flat[i : flat.size - k + 1 + i]
        rolled[: h.size] = hashed64(h)
    out = []
    for start, size in zip((np.cumsum(n) - n).tolist(), n.tolist(), strict=True):
        if size >= k:
            own = np.sort(rolled[start : start + size - k + 1])
            out.append(own[np.r_[True, own[1:] != own[:-1]]])
        elif size:
            h = np.full(1, size, dtype=np.uint64)
            for w in flat[start : start + size]:
                h = h * base + w
            out.append(hashed64(h + np.uint64(1)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def first_key(own: np.ndarray, bits: int = 64) -> tuple[int, np.ndarray]:
    """(64 bits of a set, signed, or fewer, its re-hashed members): their sum, so independent of order."""
    h = hashed64(own ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    return int(((h.sum(dtype=np.uint64) + np.uint64(own.size)) >> np.uint64(64 - bits)).astype(np.int64)), h


def set_keys(own: np.ndarray, bits: int = 64) -> tuple[int, int]:
    """The first key and 64 bits more, by which sets of equal first keys are told apart."""
    key, h = first_key(own, bits)
    return key, int(((h ^ (h >> np.uint64(29))) * np.uint64(0x5851F42D4C957F2D) ^ own).sum(dtype=np.uint64).astype(np.int64))


@dataclass(frozen=True)
class Naming:
    """How a set is named: by its first key, or by another number if a different set has that key too."""

    bits: int = 64
    renamed: dict[tuple[int, int], int] = field(default_factory=dict)

    def __call__(self, own: np.ndarray) -> int:
        if not self.renamed:
            return first_key(own, self.bits)[0]
        keys = set_keys(own, self.bits)
        return self.renamed.get(keys, keys[0])


def prefix_size(n: int) -> int:
    """Members of which two sets within the threshold must share one: n - ceil(n * 3/4) + 1."""
    a, b = SIMILAR
    return n - -(-n * a // b) + 1


def classes(docs: DataFrame, bits: int = 64) -> DataFrame:
    """Rows (doc_id, mark, n, cls, more) of the documents, and rows (token, held) of shingles that several texts of a worker
    hold. mark: a hash of the text, by which rows without an id are found again."""
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, size, id_type = Hashes(), [], 0, pa.null()
        names = ["doc_id", "mark", "n", "cls", "more", "token", "held"]

        def common() -> pa.RecordBatch:
            token = np.sort(np.concatenate(held))
            held.clear()
            first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]]) if token.size else np.zeros(0, dtype=np.int64)
            n = np.diff(np.r_[first, token.size])
            often = n >= 3
            m = int(often.sum())
            return pa.RecordBatch.from_arrays([pa.nulls(m, id_type), *[pa.nulls(m, pa.int64())] * 4, pa.array(token[first][often].astype(np.int64)), pa.array(n[often].astype(np.int64))], names=names)

        for batch in batches:
            id_type = batch.schema.field(0).type
            for part in slices(batch):
                sets = shingle_sets(part.column(1).to_pylist(), hashes)
                keys = [set_keys(s, bits) if s.size else (None, None) for s in sets]
                none = pa.nulls(part.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([s.size for s in sets], type=pa.int64()), *(pa.array(c, type=pa.int64()) for c in zip(*keys, strict=True)), none, none], names=names)
                held += sets
                size += sum(s.size for s in sets)
                if size > GATHER_TOKENS:
                    yield common()
                    size = 0
        if size:
            yield common()

    return docs.select("doc_id", "text", F.xxhash64("text").alias("mark")).mapInArrow(tidy(run), f"doc_id {kind.simpleString()}, mark long, n long, cls long, more long, token long, held long")


def told_apart(rows: DataFrame, bits: int) -> tuple[DataFrame, Naming]:
    """`rows` with one class for each distinct set, and how sets are named."""
    twice = rows.groupBy("cls").agg(F.min("more").alias("a"), F.max("more").alias("b")).filter("a <> b").select("cls")
    pairs = rows.select("cls", "more").join(twice, "cls", "left_semi").distinct().limit(RENAMED_MOST + 1).collect()
    if len(pairs) > RENAMED_MOST:
        raise ValueError(f"more than {RENAMED_MOST} different sets agree in {bits} bits")
    if not pairs:
        return rows.drop("more"), Naming(bits)
    import xxhash

    names = [(c, m, xxhash.xxh64_intdigest(f"{c} {m}") - 2**63) for c, m in pairs]
    named = rows.sparkSession.createDataFrame(names, "cls long, more long, named long")
    rows = rows.join(F.broadcast(named), ["cls", "more"], "left").withColumn("cls", F.coalesce("named", "cls")).drop("more", "named")
    return rows, Naming(bits, {(c, m): to for c, m, to in names})


def common_tokens(found: DataFrame, most: int, hot_held: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(the shingles that most texts hold, at most `most` of them; those held by `hot_held` texts or more, and how often in all).

    Their number is bounded; the join doesn't depend on it.
    """
    tokens = cut(found.filter(F.col("token").isNotNull()).groupBy("token").agg(F.sum("held").alias("held")), "jaccard-common")
    step = F.floor(F.log2("held") * 4).cast("int")
    total, least = 0, None
    for s, n in sorted(((r[0], r[1]) for r in tokens.groupBy(step.alias("s")).count().collect()), reverse=True):
        if total + n > most:
            break
        total, least = total + n, s
    if least is None:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64), 0
    table = collected(tokens.filter(step >= least).select("token", "held"))
    token, held = table.column("token").to_numpy().astype(np.uint64), table.column("held").to_numpy()
    hot = held >= hot_held
    return np.sort(token), np.sort(token[hot]), int(held[hot].sum())


def bucketed_prefixes(docs: DataFrame, common: np.ndarray, hot: np.ndarray, buckets: int, hot_buckets: int, name: Naming) -> DataFrame:
    """(bucket, tokens, cls, n, count): of each slice of texts, what falls into each bucket, as packed arrays.

    Shingles of `hot` are known by their place there and go to one of `hot_buckets` further buckets, by class.
    """
    shared = docs.sparkSession.sparkContext.broadcast((common, hot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, (last, widely) = Hashes(), shared.value
        for batch in batches:
            for part in slices(batch):
                tokens, owner, cls, size = [], [], [], []
                seen: set[int] = set()
                for own in shingle_sets(part.column(0).to_pylist(), hashes):
                    if not own.size or (c := name(own)) in seen:
                        continue
                    seen.add(c)
                    p = prefix_size(own.size)
                    if last.size:
                        often = last[np.minimum(np.searchsorted(last, own), last.size - 1)] == own
                        rare = own[~often]
                        own_prefix = rare[:p] if rare.size >= p else np.r_[rare, own[often][: p - rare.size]]
                    else:
                        own_prefix = own[:p]
                    tokens.append(own_prefix)
                    owner.append(np.full(p, len(cls), dtype=np.int32))
                    cls.append(c)
                    size.append(own.size)
                if not cls:
                    continue
                token, of = np.concatenate(tokens), np.concatenate(owner)
                c, n = np.array(cls, dtype=np.int64), np.array(size, dtype=np.int32)
                bucket, low = (token % np.uint64(buckets)).astype(np.int64), token // np.uint64(buckets)
                if widely.size:
                    place = np.minimum(np.searchsorted(widely, token), widely.size - 1)
                    wide = widely[place] == token
                    bucket[wide] = buckets + hashed64(c.view(np.uint64)[of[wide]] + np.uint64(1)).astype(np.uint64) % np.uint64(hot_buckets)
                    low[wide] = place[wide]
                order = np.lexsort((of, bucket))
                token, of, bucket = low[order], of[order], bucket[order]
                edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
                rows = []
                for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                    mine = of[a:b]
                    first = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
                    who = mine[first]
                    # the low 32 bits of a token tell it apart inside its bucket; a chance meeting is seen when sets are compared
                    rows.append((int(bucket[a]), token[a:b].astype(np.uint32).tobytes(), c[who].tobytes(), n[who].tobytes(), np.diff(np.r_[first, b - a]).astype(np.int32).tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.binary()] * 4), strict=True)], names=["bucket", "tokens", "cls", "n", "count"])

    return docs.select("text").mapInArrow(tidy(run), "bucket int, tokens binary, cls binary, n binary, count binary")


def shared_tokens(prefixes: DataFrame, buckets: int, parts: int) -> DataFrame:
    """Rows (token, cls, n) of prefix shingles that two classes or more show, and rows (cls, n, least, least_n, share) that
    count how many of them a class has in common with the least class of each.

    Buckets from `buckets` on hold a part of the classes of widely held shingles: all of these are given, and rows
    (token, least, least_n) besides, by which the parts are brought together.
    """

    def one_bucket(bucket: int, rows: list[tuple[bytes, bytes, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        token = np.concatenate([np.frombuffer(r[0], dtype=np.uint32) for r in rows])
        count = [np.frombuffer(r[3], dtype=np.int32) for r in rows]
        cls = np.concatenate([np.repeat(np.frombuffer(r[1], dtype=np.int64), k) for r, k in zip(rows, count, strict=True)])
        n = np.concatenate([np.repeat(np.frombuffer(r[2], dtype=np.int32), k) for r, k in zip(rows, count, strict=True)])
        order = np.lexsort((cls, token))
        token, cls, n = token[order], cls[order], n[order]
        new = np.r_[True, (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])]
        token, cls, n = token[new], cls[new], n[new]
        first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        length = np.diff(np.r_[first, token.size])
        keep = np.repeat((length > 1) | (bucket >= buckets), length)
        least = np.repeat(first, length)[keep]
        token, cls_k, n_k, least_cls, least_n = token[keep], cls[keep], n[keep], cls[least], n[least]
        if not token.size:
            return
        yield from batches_of([token.astype(np.int64) + (np.int64(min(bucket, buckets)) << 32), cls_k, n_k.astype(np.int64), None, None, None])
        if bucket >= buckets:
            own = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            yield from batches_of([token[own].astype(np.int64) + (np.int64(buckets) << 32), None, None, least_cls[own], least_n[own].astype(np.int64), None])
        apart = cls_k != least_cls
        a, na, b, nb = cls_k[apart], n_k[apart], least_cls[apart], least_n[apart]
        order = np.lexsort((b, a))
        a, na, b, nb = a[order], na[order], b[order], nb[order]
        first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        if not a.size:
            return
        share = np.diff(np.r_[first, a.size])
        yield from batches_of([None, a[first], na[first].astype(np.int64), b[first], nb[first].astype(np.int64), share])

    def batches_of(columns: list[np.ndarray | None], most: int = 100_000) -> Iterator[pa.RecordBatch]:
        size = next(c.size for c in columns if c is not None)
        for at in range(0, size, most):
            m = min(most, size - at)
            yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()) if c is None else pa.array(c[at : at + m], type=pa.int64()) for c in columns], names=["token", "cls", "n", "least", "least_n", "share"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, list] | None = None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0] != row[0]:
                    yield from one_bucket(*held)
                    held = None
                held = held or (row[0], [])
                held[1].append(row[1:])
        if held:
            yield from one_bucket(*held)

    return prefixes.repartitionById(parts, F.col("bucket") % parts).sortWithinPartitions("bucket").mapInArrow(tidy(run), "token long, cls long, n long, least long, least_n long, share long")


def similar_sizes(a: Column, b: Column) -> Column:
    x, y = SIMILAR
    return F.least(a, b) * y >= F.greatest(a, b) * x


def may_reach(share: Column, a: Column, b: Column) -> Column:
    """Whether sets of `a` and `b` members that share `share` of their prefixes can be within the threshold.

    Of the one whose prefix ends first, all common members up to there are counted in `share`; beyond it, it has no
    more than its other n - prefix members. The overlap must reach 3/7 of the sizes' sum.
    """
    x, y = SIMILAR
    rest = lambda n: F.ceil(n * x / y) - 1
    return (share + F.greatest(rest(a), rest(b))) * (x + y) >= (a + b) * x


def sets_of(docs: DataFrame, wanted: DataFrame, name: Naming) -> DataFrame:
    """(cls, tokens): the whole set of each class of `wanted` (cls, doc_id, mark), packed. A text is read by its id, or
    by its mark where a class has no row with an id."""
    wanted = cut(wanted, "jaccard-wanted")
    rows = docs.select("doc_id", "text").join(maybe_broadcast(wanted.filter("doc_id is not null").select("doc_id", "cls")), "doc_id").select("cls", "text")
    nameless = wanted.filter("doc_id is null").select("mark", "cls")
    if not nameless.isEmpty():
        once = docs.filter("doc_id is null").select(F.xxhash64("text").alias("mark"), "text").dropDuplicates(["mark"])
        rows = rows.unionByName(once.join(maybe_broadcast(nameless), "mark").select("cls", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            for part in slices(batch):
                sets = zip(part.column(0).to_pylist(), shingle_sets(part.column(1).to_pylist(), hashes), strict=True)
                found = {c: s.tobytes() for c, s in sets if s.size and name(s) == c}  # else another row of the same id
                yield pa.RecordBatch.from_arrays([pa.array(found, type=pa.int64()), pa.array(found.values(), type=pa.binary())], names=["cls", "tokens"])

    sets = cut(rows.mapInArrow(tidy(run), "cls long, tokens binary"), "jaccard-sets")
    # repeated rows give a set more than once
    return sets if sets.count() == wanted.count() else cut(sets.dropDuplicates(["cls"]), "jaccard-sets")


def verify(sets: DataFrame, opened: DataFrame) -> DataFrame:
    """(a, b): links found between the members of groups and the classes that opened them.

    opened: rows (grp, part, cls, comp, query): members of a group, repeated for each part, and the queries of the
    part. A query needs one link to each other component. No part has more than some GROUP_MOST members and
    OPENED_MOST queries, whatever the size of a component or of a family of near copies.
    """
    placed = sets.join(maybe_broadcast(opened), "cls").select("grp", "part", "query", "cls", "comp", "tokens")
    parts = max(1, min(opened.count() // 100 + 1, 4 * int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    placed = placed.repartition(parts, "grp", "part").sortWithinPartitions("grp", "part", F.col("query").asc(), "cls")
    x, y = SIMILAR

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, members = None, []
        for batch in batches:
            found: list[tuple[int, int]] = []
            for grp, p, query, cls, comp, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.frombuffer(tokens, dtype=np.uint64)
                if at != (grp, p):
                    at, members = (grp, p), []
                if not query:
                    members.append((cls, comp, own))
                    continue
                linked = {comp}
                for c, other_comp, other in members:
                    if other_comp in linked or min(own.size, other.size) * y < max(own.size, other.size) * x:
                        continue
                    if own.size < other.size:
                        at_ = np.searchsorted(other, own)
                        both = int((other[np.minimum(at_, other.size - 1)] == own).sum())
                    else:
                        at_ = np.searchsorted(own, other)
                        both = int((own[np.minimum(at_, own.size - 1)] == other).sum())
                    if both * y >= (own.size + other.size - both) * x:
                        found.append((cls, c))
                        linked.add(other_comp)
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, type=pa.int64()), pa.array(b, type=pa.int64())], names=["a", "b"])

    return placed.mapInArrow(tidy(run), "a long, b long").distinct()


def dealt(queries: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """Rows (grp, part, cls, comp, query) for `verify` from queries (grp, cls, comp) and members (grp, cls, comp), if other
    than the class that a group is named by. A group with many queries is repeated in several parts."""
    parts = cut(queries.groupBy("grp").agg(F.ceil(F.count("*") / OPENED_MOST).alias("parts")), "jaccard-parts")
    asked = queries.join(maybe_broadcast(parts), "grp").select("grp", F.pmod(F.xxhash64("cls"), F.col("parts")).alias("part"), "cls", "comp", F.lit(True).alias("query"))
    members = parts.select("grp", F.col("grp").alias("cls"), F.col("grp").alias("comp"), "parts") if members is None else members.join(maybe_broadcast(parts), "grp")
    spread = members.select("grp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "cls", "comp", F.lit(False).alias("query"))
    return cut(asked.unionByName(spread), "jaccard-opened")


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): each node of a bounded number of edges with the least node that they connect it with."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    nodes, at = np.unique(np.concatenate([table.column("a").to_numpy(), table.column("b").to_numpy()]), return_inverse=True)
    x, y = at[: table.num_rows], at[table.num_rows :]
    root = np.arange(nodes.size)
    while (root[x] != root[y]).any():
        np.minimum.at(root, np.maximum(root[x], root[y]), np.minimum(root[x], root[y]))
        while (root[root] != root).any():
            root = root[root]
    below = root != np.arange(nodes.size)
    yield pa.RecordBatch.from_arrays([pa.array(nodes[below]), pa.array(nodes[root[below]])], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that each other node of `edges` (a, b) is connected with.

    The edges of each FOREST_EDGES at most are first contracted in one task. If that was all of them, the roots are
    found; else large and small stars follow in turn, over what is left, until nothing changes.
    """
    now = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    parts = max(1, math.ceil(now.count() / FOREST_EDGES))
    now = cut(now.coalesce(parts).mapInArrow(forest, "a long, b long"), "components")
    before = None
    while parts > 1:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        now = cut(small, "components")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).groupBy("node").agg(F.min("root").alias("root"))


def apart(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """(token, cls, n, comp) of the shingles that classes of more than one component show."""
    placed = shared.join(maybe_broadcast(roots.select(F.col("node").alias("cls"), "root")), "cls", "left").withColumn("comp", F.coalesce("root", "cls")).drop("root")
    placed = cut(placed, "jaccard-placed")
    mixed = placed.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("token")
    return cut(placed.join(mixed, "token", "left_semi"), "jaccard-apart")


def stars_again(open_: DataFrame, attempt: int) -> DataFrame:
    """(grp, cls): classes with a few of the classes, drawn by hash for each shingle, that they have most shingles in common with.

    Near copies of one text are often a link apart from some of each other only. A few tries each connect most of
    them, at a cost in proportion to their number, before groups are compared as a whole.
    """
    who = F.struct("cls", "n", "comp")
    centers = open_.groupBy("token").agg(F.array_distinct(F.array(*(F.min_by(who, F.xxhash64("cls", F.lit(17 * attempt + k))) for k in range(STAR_CENTERS)))).alias("centers"))
    met = open_.join(centers, "token").select("cls", "n", "comp", F.explode("centers").alias("c")).filter((F.col("c.comp") != F.col("comp")) & similar_sizes(F.col("n"), F.col("c.n")))
    share = met.groupBy("cls", "comp", F.col("c.cls").alias("grp")).agg(F.count("*").alias("share"), F.max("n").alias("n"), F.max("c.n").alias("m"))
    # a center is drawn for most of what it has in common with a near copy; others aren't worth a try
    share = share.filter(may_reach(F.col("share"), F.col("n"), F.col("m")))
    best = share.groupBy("cls", "comp").agg(F.slice(F.sort_array(F.collect_list(F.struct("share", "grp")), asc=False), 1, STAR_CENTERS).alias("best"))
    return cut(best.select("cls", "comp", F.explode("best.grp").alias("grp")), "jaccard-stars")


def grouped(open_: DataFrame) -> DataFrame:
    """`open_` with the group of each class, and whether it is of one large component.

    A group has some GROUP_MOST similar classes at most: of one component if that has more of them, else of those that
    show the same shingle, which is the one of their own that most classes show. Which classes are together
    changes the work only.
    """
    held = open_.groupBy("token").agg(F.count("*").alias("held"))
    home = open_.join(held, "token").groupBy("cls").agg(F.max("comp").alias("comp"), F.max_by("token", F.struct("held", "token")).alias("home"))
    large = home.groupBy("comp").agg(F.count("*").alias("size")).filter(F.col("size") > GROUP_MOST).select("comp", F.lit(True).alias("large"))
    home = home.join(maybe_broadcast(cut(large, "jaccard-large")), "comp", "left").select("cls", F.col("large").isNotNull().alias("large"), F.when(F.col("large").isNull(), F.col("home")).otherwise(F.col("comp")).alias("family"))
    home = cut(home, "jaccard-home")
    many = home.groupBy("large", "family").agg(F.ceil(F.count("*") / GROUP_MOST).alias("groups"))
    home = home.join(maybe_broadcast(cut(many, "jaccard-many")), ["large", "family"]).select("cls", "large", F.xxhash64("large", "family", F.pmod(F.xxhash64("cls", F.lit(1)), "groups")).alias("grp"))
    return cut(open_.join(home, "cls"), "jaccard-open")


def qualifying(open_: DataFrame) -> DataFrame:
    """(cls, comp, grp): the groups that a class must be compared with, by the matrix of shingles and groups.

    Of two groups the lesser asks the other, and those of large components come last: they are asked, and ask only
    each other. A shingle counts if a class of another component shows it in the group.
    """
    matrix = open_.groupBy("token", "grp", "large").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("comp").alias("c_low"), F.max("comp").alias("c_high"))
    q, g = (lambda c: F.col(f"q.{c}")), (lambda c: F.col(f"g.{c}"))
    x, y = SIMILAR
    later = (q("large") < g("large")) | ((q("large") == g("large")) & (q("grp") <= g("grp")))
    other = (g("c_low") != q("comp")) | (g("c_high") != q("comp"))
    meet = open_.alias("q").join(matrix.alias("g"), (q("token") == g("token")) & later & other & (q("n") * x <= g("high") * y) & (g("low") * x <= q("n") * y))
    bound = meet.groupBy("q.cls", "q.comp", "g.grp").agg(F.count("*").alias("share"), F.max("q.n").alias("n"), F.min("g.low").alias("low"), F.max("g.high").alias("high"))
    # the size inside the group's range that needs the fewest common shingles: the ends of what is similar to the query
    # (at the upper end, one shingle less may do for a size just below it, as prefixes are whole numbers)
    ends = [F.greatest(F.col("low"), F.ceil(F.col("n") * x / y)), F.least(F.col("high"), F.floor(F.col("n") * y / x))]
    return cut(bound.filter(may_reach(F.col("share"), F.col("n"), ends[0]) | may_reach(F.col("share") + 1, F.col("n"), ends[1])).select("cls", "comp", "grp"), "jaccard-bound")


def narrowed(open_: DataFrame, bound: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(queries, members), each (grp, cls, comp): of qualifying classes and groups what a pair of the two can need.

    A group's union has more than any member shows. So groups are opened by their prefixes first, in tasks of one
    group and some of its queries; whole sets are read for those only that a single pair may link.
    """
    shows = open_.groupBy("cls").agg(F.max("n").alias("n"), F.collect_list("token").alias("tokens"))
    opened = dealt(bound, open_.select("grp", "cls", "comp").distinct())
    rows = shows.join(maybe_broadcast(opened), "cls").select("grp", "part", "query", "cls", "comp", "n", "tokens")
    parts = max(1, min(opened.count() // 1000 + 1, 4 * int(open_.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    placed = rows.repartition(parts, "grp", "part").sortWithinPartitions("grp", "part", F.col("query").asc(), "cls")
    x, y = SIMILAR

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, members, found = None, [], []

        def matrix() -> tuple[np.ndarray, ...]:
            own = [m[3] for m in members]
            token, of = np.concatenate(own), np.repeat(np.arange(len(own)), [t.size for t in own])
            order = np.argsort(token, kind="stable")
            return token[order], of[order], np.array([m[2] for m in members]), np.array([m[1] for m in members])

        def give(kept: dict[int, tuple[int, int]] | None = None) -> Iterator[pa.RecordBatch]:
            rows = found + [(at[0], *k, False) for k in (kept or {}).values()]
            found.clear()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], names=["grp", "cls", "comp", "query"])

        table, kept = None, {}
        for batch in batches:
            for grp, part, query, cls, comp, n, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != (grp, part):
                    if at:
                        yield from give(kept)
                    at, members, table, kept = (grp, part), [], None, {}
                own = np.array(tokens, dtype=np.int64)
                if not query:
                    members.append((cls, comp, n, own))
                    continue
                table = table or matrix()
                token, of, sizes, comps = table
                low, high = np.searchsorted(token, own, "left"), np.searchsorted(token, own, "right")
                share = np.bincount(of[np.concatenate([np.arange(a, b) for a, b in zip(low, high, strict=True)])], minlength=sizes.size)
                rest = np.maximum(-(-sizes * x // y) - 1, -(-n * x // y) - 1)
                able = (share > 0) & (comps != comp) & ((share + rest) * (x + y) >= (sizes + n) * x) & (np.minimum(sizes, n) * y >= np.maximum(sizes, n) * x)
                if able.any():
                    found.append((grp, cls, comp, True))
                    kept.update((i, members[i][:2]) for i in np.flatnonzero(able).tolist() if i not in kept)
        if at:
            yield from give(kept)

    some = cut(placed.mapInArrow(tidy(run), "grp long, cls long, comp long, query boolean").distinct(), "jaccard-narrowed")
    return some.filter("query").drop("query"), some.filter("not query").drop("query")


def join_components(docs: DataFrame, common_most: int = COMMON_MOST, bucket_tokens: int = BUCKET_TOKENS, hot_held: int = HOT_HELD, bits: int = 64) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of `docs` (doc_id, text), at 5-word shingles and Jaccard 3/4 or more.

    Texts without words, null ones too, have no shingles and are alone: their component is their own id. Copies
    share a class; repeated rows each give a row. component_id is the least id that links reach; null if no
    row that they reach has an id. An empty table gives no rows; further columns are ignored. The links are those
    of all pairs within the threshold; none is sampled or capped.
    """
    found = cut(classes(docs, bits), "jaccard-classes")
    rows, name = told_apart(found.filter(F.col("n").isNotNull()).select("doc_id", "mark", "n", "cls", "more"), bits)
    common, hot, hot_rows = common_tokens(found, common_most, hot_held)
    reps = rows.filter(F.col("cls").isNotNull()).groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.min("mark").alias("mark"), F.max("n").alias("n"))
    reps = cut(reps, "jaccard-reps")
    shown = reps.agg(F.sum(F.col("n") - F.ceil(F.col("n") * SIMILAR[0] / SIMILAR[1]) + 1)).first()[0] or 0
    buckets, hot_buckets = max(2, math.ceil(shown / bucket_tokens)), max(1, math.ceil(hot_rows / bucket_tokens))
    met = cut(shared_tokens(bucketed_prefixes(docs, common, hot, buckets, hot_buckets, name), buckets, min(buckets + hot_buckets, 20_000)), "jaccard-met")
    shared = met.filter(F.col("token").isNotNull() & F.col("cls").isNotNull()).select("token", "cls", "n")
    # stars: each class with the least class that it meets most of
    stars = met.filter(F.col("token").isNull()).select("cls", "n", "least", "least_n", "share")
    if hot.size:
        ends = met.filter(F.col("cls").isNull()).select("token", F.col("least").alias("cls"), F.col("least_n").alias("n"))
        first = ends.groupBy("token").agg(F.min(F.struct("cls", "n")).alias("first"))
        stars = stars.unionByName(ends.join(first, "token").filter(F.col("cls") != F.col("first.cls")).select("cls", "n", F.col("first.cls").alias("least"), F.col("first.n").alias("least_n"), F.lit(1).cast("long").alias("share")))
    stars = stars.groupBy("cls", "least").agg(F.sum("share").alias("share"), F.max("n").alias("n"), F.max("least_n").alias("m"))
    stars = stars.filter(similar_sizes(F.col("n"), F.col("m")) & may_reach(F.col("share"), F.col("n"), F.col("m")))
    best = cut(stars.groupBy("cls").agg(F.max_by("least", F.struct("share", "least")).alias("grp")).withColumn("comp", F.col("cls")), "jaccard-stars")
    sets = docs.sparkSession.createDataFrame([], "cls long, tokens binary")

    def linked(opened: DataFrame) -> DataFrame:
        """Links of what is opened; sets that no round has asked for before are made first, and kept."""
        nonlocal sets
        lacking = reps.join(opened.select("cls").distinct(), "cls", "left_semi").join(sets.select("cls"), "cls", "left_anti")
        sets = sets.unionByName(sets_of(docs, lacking.drop("n"), name))
        return cut(verify(sets, opened), "jaccard-links")

    links = linked(dealt(best))
    roots = cut(components(links), "jaccard-roots")
    open_ = apart(shared, roots)
    for attempt in range(STAR_ROUNDS + 1):
        if open_.isEmpty():
            break
        if attempt < STAR_ROUNDS:
            opened = dealt(stars_again(open_, attempt))
        else:
            open_ = grouped(open_)
            opened = dealt(*narrowed(open_, qualifying(open_)))
        links = links.unionByName(linked(opened))
        roots = cut(components(links), "jaccard-roots")
        if attempt < STAR_ROUNDS:
            open_ = apart(shared, roots)
    # the least id of each component, by class
    by_class = reps.select("cls", "doc_id").join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = by_class.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    final = by_class.select("cls", "root").join(least, "root").select("cls", "component_id")
    out = rows.join(final, "cls", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that keep one row of each component, of the least id; those without shingles all stay.

    Rows are joined by a number of their own, written once, so that repeated and null ids are told apart. Of several
    rows of the least id the first stays; a component without ids keeps its first row.
    """
    docs, columns = cut(docs.withColumn("__row", F.monotonically_increasing_id()), "jaccard-rows"), docs.columns
    found = join_components(docs.select(F.col("__row").alias("doc_id"), "text")).select(F.col("doc_id").alias("__row"), "component_id")
    named = found.join(docs.select("__row", "doc_id"), "__row")
    first = F.min_by("__row", F.struct(F.col("doc_id").isNull(), "doc_id", "__row"))
    kept = named.groupBy("component_id").agg(first.alias("__row")).select("__row")
    return docs.join(kept, "__row", "left_semi").select(*columns)
