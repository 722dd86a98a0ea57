import random
from collections import Counter, defaultdict

import pytest
from cases_path import cases

from ratewright.llm import jaccard


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def labelled(data):
    """(id, shingles, a number of its component) of each row, by all pairs."""
    sets = [shingles(t) for _, t, *_ in data]
    root = list(range(len(data)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                root[find(i)] = find(j)
    return [(d, len(sets[i]), find(i)) for i, (d, *_) in enumerate(data)]


def brute(data):
    found, least = labelled(data), defaultdict(list)
    for d, _, c in found:
        least[c].append(d)
    return Counter((d, n, min((x for x in least[c] if x is not None), default=None)) for d, n, c in found)


def drifted(seed, chains=6, length=9):
    """Chains in which neighbours are similar and ends are not, stars, and passages that many share."""
    r = random.Random(seed)
    data, passage = cases.rows(seed), cases.prose(r, 60)
    for c in range(chains):
        w = cases.prose(r, r.choice([8, 20, 60, 200])).split()
        for k in range(length):
            data.append((1000 + 100 * c + k, " ".join(w), "en", "s1", 1))
            for _ in range(max(1, len(w) // 60)):
                w[r.randrange(len(w))] = cases.word(r) + "x"
            if r.random() < 0.3:
                w.append(cases.word(r))
    data += [(5000 + k, f"{passage} {cases.prose(r, r.randint(2, 60))}", "en", "s1", 1) for k in range(40)]
    r.shuffle(data)
    return data


@pytest.mark.parametrize(
    ("seed", "common", "bucket", "group", "rounds", "hot", "bits"), [(1, 300_000, 1_000_000, 64, 2, 20_000, 64), (2, 0, 500, 3, 2, 20_000, 64), (3, 50, 2000, 1, 0, 3, 64), (4, 300_000, 300, 5, 0, 3, 5)]
)
def test_components(spark, monkeypatch, seed, common, bucket, group, rounds, hot, bits):
    monkeypatch.setattr(jaccard, "GROUP_MOST", group)
    monkeypatch.setattr(jaccard, "OPENED_MOST", 7)
    monkeypatch.setattr(jaccard, "STAR_ROUNDS", rounds)
    data = drifted(seed)
    # near copies of a text without an id, and a chain that only such a row connects
    r = random.Random(seed)
    w = cases.prose(r, 40).split()
    data += [(9000, " ".join(w)), (None, " ".join([*w, *["p q r s"] * 3])), (9001, " ".join([*w[4:], *["p q r s"] * 3])), (None, " ".join([*w, "t"]))]
    data = [(*x, None, None, None)[:5] for x in data]
    found = jaccard.join_components(cases.table(spark, data), common_most=common, bucket_tokens=bucket, hot_held=hot, bits=bits).collect()
    assert Counter(map(tuple, found)) == brute(data)


def family(seed, size, edits):
    """Near copies of one text, of which many are further than the threshold from each other."""
    r = random.Random(seed)
    base, out = cases.prose(r, 120).split(), []
    for k in range(size):
        w = list(base)
        for _ in range(edits):
            w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
        out.append((k, " ".join(w), "en", "s1", 1))
    return out


def test_matrix_of_a_family(spark):
    """Rows of the matrix join: a class meets groups of similar classes, not each class."""
    n, group = 300, jaccard.GROUP_MOST
    cls = [(t, c, 100, c) for c in range(n) for t in range(20) if t < 2 or (c * 7 + t) % 3]
    open_ = jaccard.grouped(spark.createDataFrame(cls, "token long, cls long, n long, comp long"))
    groups = {r[0]: r[1] for r in open_.select("grp", "cls").distinct().groupBy("grp").count().collect()}
    assert len(groups) == -(-n // group)
    asked = jaccard.qualifying(open_)
    assert asked.count() <= n * (len(groups) + 1) and asked.select("cls").distinct().count() == n
    data = family(3, 200, 4)
    assert Counter(map(tuple, jaccard.join_components(cases.table(spark, data)).collect())) == brute(data)


def test_empty(spark):
    assert jaccard.join_components(cases.empty(spark)).count() == 0
    only = [(1, None, None, None, None), (2, "", None, None, 0)]
    assert Counter(map(tuple, jaccard.join_components(cases.table(spark, only)).collect())) == brute(only)


def test_one_of_each(spark):
    data = drifted(5)
    docs = cases.table(spark, data)
    out = jaccard.one_of_each(docs)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} - {None} == {d for d, n, c in brute(data) if d == c and d is not None}


def test_one_row_of_each(spark):
    r = random.Random(9)
    a, b, c, d = (cases.prose(r, 60) for _ in range(4))
    near = lambda t, k: " ".join([*t.split(), f"more{k}"])
    texts = [(1, a), (1, a), (1, near(a, 1)), (2, near(a, 2)), (3, b), (1, b), (4, c), (4, d), (5, d), (4, d)]
    e, f = cases.prose(r, 60), cases.prose(r, 60)
    texts += [(None, e), (None, near(e, 1)), (None, near(e, 1)), (None, f), (6, near(f, 1)), (None, "alone without an id"), (None, None), (None, ""), (7, None), (7, None)]
    out = jaccard.one_of_each(cases.table(spark, [(i, t, "en", "s1", 1) for i, t in texts])).collect()
    want = [(1, a), (1, b), (4, c), (4, d), (None, e), (6, near(f, 1)), (None, "alone without an id"), (None, None), (None, ""), (7, None), (7, None)]
    own = lambda i, t: (i, None if not t else " ".join(t.split()[:20]))  # noqa: E731  any of the near copies of an id will do
    assert Counter(own(x.doc_id, x.text) for x in out) == Counter(own(*x) for x in want)


@pytest.mark.parametrize("most", [1_000_000, 100])
def test_components_of_a_graph(spark, monkeypatch, most):
    monkeypatch.setattr(jaccard, "FOREST_EDGES", most)
    r = random.Random(8)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(40)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {x.node: x.root for x in jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(x, x) == find(x) for x in list(root))
