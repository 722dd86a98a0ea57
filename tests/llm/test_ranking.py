import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from cases_path import cases

from ratewright.llm import oracle, ranking


def terms(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(docs, items, top=20):
    own = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    n, total = sum(1 for x in own if x[2]), sum(x[2] for x in own)
    df = Counter(t for _, c, _ in own for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c, length in own:
            m = 75 + (25 * length * n) // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, k + 1, None if absent else i, -s) for k, (s, absent, i) in enumerate(sorted(found)[:top])]
    return sorted(out, key=str)


def queries(data, count=25, seed=3):
    r = random.Random(seed)
    out = []
    for k in range(count):
        w = (r.choice(data)[1] or "").split() or ["nothing"]
        a = r.randrange(len(w))
        out.append((k, " ".join(w[a : a + r.randint(1, 30)])))
    return [*out, (90, None), (91, ""), (92, "zzz unseen"), (93, "the THE the, an-er"), (93, "the THE the, an-er"), (None, "an er ti")]


def table_of(spark, items):
    return spark.createDataFrame([(i, t, "x", 0) for i, t in items], "item_id long, text string, doc_id string, score int")


@pytest.mark.parametrize(("postings", "top"), [(1_000_000, 20), (1_000_000, 3)])
def test_against_brute_force(spark, monkeypatch, postings, top):
    data = cases.rows(4, 150)
    items = queries(data)
    docs = cases.table(spark, data).repartition(5)
    got = sorted(map(tuple, ranking.rank(docs, table_of(spark, items), top).collect()), key=str)
    assert got == brute([x[:2] for x in data], items, top)
    assert ranking.rank(cases.empty(spark), table_of(spark, items)).count() == 0
    assert ranking.rank(docs, table_of(spark, [])).count() == 0


def test_blocks_of_items_over_an_index_of_all_terms(spark, monkeypatch):
    data = cases.rows(5)
    items = queries(data)
    monkeypatch.setattr(ranking, "QUERY_BYTES", 500)
    got = sorted(map(tuple, ranking.rank(cases.table(spark, data), table_of(spark, items)).collect()), key=str)
    assert got == brute([x[:2] for x in data], items)


def test_sql_on_the_same_rows(spark):
    data = [x for x in cases.rows(6) if x[0] is not None]
    items = [x for x in queries(data) if x[0] not in (93, None)]
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [x[0] for x in data], "text": [x[1] for x in data]}))
    con.register("benchmark", pa.table({"item_id": [x[0] for x in items], "text": [x[1] for x in items]}))
    got = sorted(map(tuple, ranking.rank(cases.table(spark, data), table_of(spark, items)).collect()), key=str)
    assert got == sorted(con.execute(oracle.RANKING).fetchall(), key=str)


def test_many_small_shards_in_a_task(monkeypatch):
    """The last place's score goes on from shard to shard; pieces of a long text are one document."""
    r = random.Random(8)
    data = [(i, " ".join(r.choice(["a", "b", "c", "rare" + str(r.randrange(40)), "d"]) for _ in range(r.randint(0, 80)))) for i in range(400)]
    monkeypatch.setattr(ranking, "SHARD_POSTINGS", 60)
    monkeypatch.setattr(ranking, "CHUNK_BYTES", 100)
    builder, shards = ranking.Builder(None), []
    for i, t in data:
        builder.add([i], [t.encode()])
        shards += builder.shard() if builder.full() else []
    shards = [s.to_pylist()[0] for s in [*shards, *builder.shard()]]
    assert len(shards) > 20
    n, total = sum(s["n_docs"] for s in shards), sum(s["n_terms"] for s in shards)
    df = Counter()
    for s in shards:
        df.update(dict(zip(s["terms"], s["sizes"], strict=True)))
    items = [(k, t) for k, t in enumerate(["a b", "rare1 rare2 rare3", "a rare5 rare5", "d d d"])]
    number = {t: i for i, t in enumerate(df)}
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * c + 1))) for t, c in df.items()}
    of = [(np.array([number[x] for x in c]), np.array([weight[x] * k for x, k in c.items()])) for c in (ranking.terms_of(t) for _, t in items)]
    best = ranking.Best(ranking.Queries(number, of, 7, n, total))
    for s in shards:
        best.take(ranking.Shard(s, best.q))
    got = sorted(((i, k + 1, int(d), int(s)) for i, (score, _, doc) in enumerate(best.held) for k, (s, d) in enumerate(zip(score, doc, strict=True))), key=str)
    assert got == brute(data, items, 7)


def error(scores, docs, edges, cost):
    return sum((docs[b - 1] - docs[a] + 1) * max(scores[a:b]) - sum(scores[a:b]) + cost for a, b in zip(edges, edges[1:], strict=False))


def least_error(scores, docs, cost):
    """The least sum over all cuts of one list, by trying each."""
    n = len(scores)
    return min(error(scores, docs, [0, *(i + 1 for i in range(n - 1) if bits >> i & 1), n], cost) for bits in range(1 << (n - 1)))


def test_block_boundaries_are_the_best(monkeypatch):
    r = random.Random(2)
    for trial in range(60):
        lists = [[r.randrange(1000) for _ in range(r.randint(1, 11))] for _ in range(r.randint(1, 6))]
        cost = r.choice([0, 50, 400, 5000])
        docs = [sorted(r.sample(range(30), len(x))) for x in lists]
        flat, places, sizes = np.array([x for one in lists for x in one]), np.array([x for one in docs for x in one]), np.array([len(x) for x in lists])
        starts = ranking.block_starts(flat, places, sizes, cost).tolist()
        at = 0
        for one, own in zip(lists, docs, strict=True):
            edges = [s - at for s in starts if at <= s < at + len(one)] + [len(one)]
            assert edges[0] == 0
            assert error(one, own, edges, cost) == least_error(one, own, cost)
            at += len(one)
    long_ = np.array([r.randrange(10) for _ in range(1000)])
    assert set(range(0, 1000, ranking.RUN)) <= set(ranking.block_starts(long_, np.arange(1000), np.array([1000]), 3).tolist())


def test_blocks_are_skipped():
    """Few documents are scored exactly where one term decides."""
    builder = ranking.Builder(None)
    builder.add([*range(5000)], [b"common word " * (1 + i % 3) + (b"gold" if i % 1000 == 7 else b"tin") for i in range(5000)])
    row = next(builder.shard()).to_pylist()[0]
    weight = {t: math.floor(1000 * math.log(10002 / (2 * n + 1))) for t, n in zip(row["terms"], row["sizes"], strict=True)}
    number = {t: i for i, t in enumerate(weight)}
    q = ranking.Queries(number, [(np.array([number[b"common"], number[b"gold"]]), np.array([weight[b"common"], weight[b"gold"]]))], 5, 5000, row["n_terms"])
    shard, seen = ranking.Shard(row, q), []
    exact = shard.exact
    shard.exact = lambda places, *x: (seen.append(places.size), exact(places, *x))[1]
    places, _ = shard.search(*q.of[0], 1, 5)
    assert sorted(places.tolist()) == [7, 1007, 2007, 3007, 4007] and sum(seen) < 200


def test_text_of_many_megabytes(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma " * 1_200_000), (2, "alpha beta"), (3, "delta")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "beta"), (2, "delta")], "item_id long, text string")
    assert sorted(map(tuple, ranking.rank(docs, items).collect())) == brute([(1, "alpha beta gamma " * 1_200_000), (2, "alpha beta"), (3, "delta")], [(1, "beta"), (2, "delta")])
