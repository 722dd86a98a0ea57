import random
import re
from collections import Counter

import pytest
from cases_path import cases

from ratewright.llm import contamination as c


def words(text):
    low = "".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text, items, window=13):
    own, hit, names = words(text), set(), set()
    for name, t in items:
        w = words(t)
        k = min(window, len(w))
        wins = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()
        for i in range(len(own) - k + 1 if k else 0):
            if tuple(own[i : i + k]) in wins:
                hit |= set(range(i, i + k))
                names.add(str(name))
    return len(own), len(hit), len(names), c.digest(list(names)), bool(hit) and 20 * len(hit) >= len(own)


def bench(spark, items):
    return spark.createDataFrame([(i, t, "clash", "x") for i, t in items], "item_id long, text string, doc_id string, found string")


def sample(seed):
    r = random.Random(seed)
    items = [(i, cases.prose(r, r.randint(14, 40))) for i in range(12)]
    items += [(50, items[0][1]), (51, "Two Words"), (52, None), (53, "..."), (54, "a a a a a a a a a a a a a a a a"), (55, " ".join(items[1][1].split()[3:20])), (3, items[3][1])]
    data = cases.rows()
    for k in range(25):
        src = words(items[r.randrange(12)][1])
        a = r.randrange(max(1, len(src) - 12))
        piece = " ".join(src[a : a + r.randint(10, 30)])
        data.append((500 + k, f"{cases.prose(r, r.randint(0, 90))}. {piece.upper()}, {cases.prose(r, 5)} {piece}", "en", "s1", 1))
    data += [(600, "a " * 40, "en", "s1", 1), (601, "two-words", "en", "s1", 1), (602, "x two\nWORDS two words", "en", "s1", 1)]
    return data, items


@pytest.mark.parametrize("block", [1 << 24, 400])
def test_against_brute_force(spark, block):
    data, items = sample(4)
    found = c.find_contamination(cases.table(spark, data), bench(spark, items), block_bytes=block).collect()
    assert Counter(tuple(r)[:6] for r in found) == Counter((i, *brute(t, items)) for i, t, *_ in data)


def test_longest_match(spark):
    data, items = sample(9)
    by = {str(i): words(t) for i, t in items}
    for r in c.find_contamination(cases.table(spark, data), bench(spark, items)).collect():
        if r.longest:
            own = next(words(t) for i, t, *_ in data if i == r.doc_id and len(words(t)) == r.n_words)
            stretch = own[r.longest_at : r.longest_at + r.longest]
            theirs = by[r.longest_item]
            assert any(theirs[i : i + r.longest] == stretch for i in range(len(theirs)))


def test_empty_tables(spark):
    data, items = sample(1)
    assert c.find_contamination(cases.empty(spark), bench(spark, items)).count() == 0
    assert not any(r.n_hit for r in c.find_contamination(cases.table(spark, data), bench(spark, [])).collect())


def test_removal_keeps_clean_rows_whole(spark):
    data, items = sample(2)
    docs = cases.table(spark, data)
    out = c.remove_contaminated(docs, bench(spark, items))
    assert out.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter((i, t) for i, t, *_ in data if not brute(t, items)[4])


def test_longest_match_of_each_suffix(spark):
    data, items = sample(7)
    data, items = data[:40] + data[-28:], items[:4] + [items[-1], (51, "Two Words"), (None, "no id at all"), (52, None)]
    want = {}
    for name, t in items:
        if name is None:
            continue
        w = words(t)
        for j in range(len(w)):
            best = None
            for i, text, *_ in data:
                own = words(text)
                for p in range(len(own)):
                    m = 0
                    while j + m < len(w) and p + m < len(own) and w[j + m] == own[p + m]:
                        m += 1
                    if m and (best is None or (-m, i is None, i or 0, p) < best[0]):
                        best = ((-m, i is None, i or 0, p), (str(name), j, m, i, p))
            if best:
                old = want.get((str(name), j))
                want[str(name), j] = min(old, best) if old else best
    for block in (1 << 24, 300):
        found = c.longest_matches(cases.table(spark, data), bench(spark, items), block_bytes=block).collect()
        assert sorted(map(tuple, found)) == sorted(b for _, b in want.values())


def test_clashing_columns_and_items_without_id(spark):
    data, items = sample(3)
    docs = cases.table(spark, data).withColumnsRenamed({"part": "__spans", "cls": "__n_words"})
    out = c.remove_contaminated(docs, bench(spark, items), block_bytes=400)
    assert out.columns == docs.columns and out.count() == sum(not brute(t, items)[4] for _, t, *_ in data)
    row = c.find_contamination(cases.table(spark, [(1, "w1 two words w2", "en", "s", 1)]), bench(spark, [(None, "Two Words"), (7, "two words")])).first()
    assert (row.n_items, row.items_sha256) == (2, c.digest(["7"]))
