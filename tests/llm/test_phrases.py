import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
from cases_path import cases

from ratewright.llm import oracle, phrases


def pieces(text):
    text = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return [[w for w in re.split("[ \t]", p) if w] for p in re.split("[.,;:!?\n\x0b\x0c\r]", text)]


def counted(rows, most):
    f = Counter()
    for lang, text in rows:
        for p in pieces(text):
            for k in range(1, most + 1):
                f.update((lang or "und", " ".join(p[i : i + k])) for i in range(len(p) - k + 1))
    return f


def brute(rows, most=3, least=10, inside=50, top=2000):
    f = counted(rows, most)
    n = Counter()
    for (lang, p), c in f.items():
        n[lang] += c * (" " not in p)
    out = []
    for lang in n:
        own = {p: c for (x, p), c in f.items() if x == lang and " " in p and c >= least}
        found = []
        for p, a in own.items():
            w = p.split(" ")
            if any(len(q) > len(p) and f" {p} " in f" {q} " and 100 * b >= inside * a for q, b in own.items()):
                continue
            cuts = []
            for k in range(1, len(w)):
                left, r = f[lang, " ".join(w[:k])], f[lang, " ".join(w[k:])]
                cuts.append((1_000_000 * a * a // (left * r), k, left, r))
            score, _, left, r = min(cuts)
            found.append((-score, -a, p.encode(), left, r))
        out += [(lang, i + 1, p.decode(), -a, left, r, n[lang], -s) for i, (s, a, p, left, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def some_rows(seed=1, count=60):
    r = random.Random(seed)
    data = cases.rows(seed, count)
    words = ["new", "york", "city", "of", "the", "é", "Ünder", "x" * 40, "a\x00b", "the"]
    data += [(1000 + i, " ".join(r.choice(words) + r.choice(["", "", ",", ".\n", "\t", "\x0b"]) for _ in range(r.randint(0, 60))).replace("york", "YORK city"), r.choice(["en", "de", None, "und"]), "s", 1) for i in range(80)]
    return data


def test_against_brute_force(spark):
    data = some_rows()
    rows = [(x[2], x[1]) for x in data]
    docs = cases.table(spark, data)
    for most, least, inside, top, size in ((3, 10, 50, 2000, 26), (3, 4, 90, 15, 16), (4, 5, 50, 40, 15), (2, 3, 50, 2000, 15)):
        assert sorted(map(tuple, phrases.collocations(docs, most, least, inside, top, size).collect())) == brute(rows, most, least, inside, top)
    assert phrases.collocations(cases.empty(spark)).count() == 0
    assert phrases.collocations(docs.drop("lang"), least=40).select("lang").distinct().first()[0] == "und"


def test_sql_on_the_same_rows(spark):
    data = some_rows(2)
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [x[0] for x in data], "text": [x[1] for x in data], "lang": [x[2] for x in data]}))
    want = sorted(con.execute(oracle.PHRASES).fetchall())
    assert sorted(map(tuple, phrases.collocations(cases.table(spark, data)).collect())) == want and len(want) > 20


def test_exact_products(spark):
    """The arithmetic of the score beyond 64 bits."""
    row = spark.sql("select (cast(1000000 as decimal(7,0)) * (cast(3000000007 as decimal(19,0)) * cast(3000000007 as decimal(19,0)))) div (cast(3000000019 as decimal(19,0)) * cast(4000000000037 as decimal(19,0))) as x").first()
    assert row.x == 1_000_000 * 3000000007**2 // (3000000019 * 4000000000037)


def test_blocks_and_numbers_start_anew(monkeypatch):
    """Phrases across ends of blocks and pieces of a long text, and words that are numbered again."""
    r = random.Random(5)
    texts = [" ".join(r.choice(["a", "b", "c", "d."]) for _ in range(300)), "", "a", "a b", " ".join(r.choice(["p", "q"]) for _ in range(500))]
    monkeypatch.setattr(phrases, "BLOCK_WORDS", 7)
    monkeypatch.setattr(phrases, "DISTINCT_WORDS", 4)
    monkeypatch.setattr(phrases, "CHUNK_BYTES", 50)
    monkeypatch.setattr(phrases, "HELD", 30)
    every = np.full(1 << 12, 255, dtype=np.uint8)
    for k in (1, 2, 3):
        c, found = phrases.Counter(phrases.Pass(k, 3, 1, 15, every, every)), Counter()
        batches = []
        for t in texts:
            for piece in phrases.pieces_of(t.encode(), phrases.BREAK, 50):
                c.feed([piece], ["en"], whole=False)
                batches += c.count() if c.full() else []
            c.feed([b""], ["en"])
        batches += [*c.count(last=True), *c.rows()]
        for b in batches:
            for x in b.to_pylist():
                found[x["lang"], x["phrase"]] += x["n"]
        assert found == Counter({p: n for p, n in counted([("en", t) for t in texts], 3).items() if p[1].count(" ") == k - 1})


def test_text_of_many_megabytes(spark):
    text = "alpha beta gamma " * 1_200_000
    rows = phrases.collocations(spark.createDataFrame([(1, text, "en"), (2, "alpha beta", "en")], "doc_id long, text string, lang string")).collect()
    n = 1_200_000
    assert {(x.phrase, x.a) for x in rows} == {("alpha beta gamma", n), ("beta gamma alpha", n - 1), ("gamma alpha beta", n - 1)}
