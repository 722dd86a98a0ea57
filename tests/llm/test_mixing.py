import re
from collections import Counter, defaultdict

import pytest
from cases_path import cases

from ratewright.llm import mixing


def brute_targets(sizes, most=3.0):
    """Water-filling in rounds: cap whoever is above, share what is left by weight, until none is."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in capped]
        if not rest:
            return capped
        level = (total - sum(capped.values())) / sum(weight[s] for s in rest)
        above = [s for s in rest if level * weight[s] > most * sizes[s]]
        if not above:
            return capped | {s: level * weight[s] for s in rest}
        capped |= {s: most * sizes[s] for s in above}


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check(rows, data):
    sizes = defaultdict(int)
    for _, t, _, s, _ in data:
        sizes[s] += words(t)
    targets = brute_targets(dict(sizes))
    assert sorted((str(r.doc_id), r.size) for r in rows) == sorted((str(i), words(t)) for i, t, *_ in data)
    taken, open_, at_hand = defaultdict(int), defaultdict(Counter), defaultdict(int)
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(targets[r.source], rel=1e-9, abs=1e-9)
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
        taken[r.source] += r.taken
        if r.size and abs(targets[r.source] / sizes[r.source] - round(targets[r.source] / sizes[r.source])) > 1e-9:
            open_[r.source][r.doc_id, r.size] += 1
    for s, t in targets.items():
        # what is left is less than the smallest unit that could have settled it; with few units, than the largest
        units = [n * times for (_, n), times in open_[s].items()]
        near = 0.5 if not units else min(units) if len(units) >= 100 else max(units)
        assert abs(taken[s] - t) <= near, (s, taken[s], t, near, len(units))


def test_cases(spark):
    data = cases.rows()
    check(mixing.mix(cases.table(spark)).collect(), data)
    assert mixing.mix(cases.empty(spark)).count() == 0


def test_tree_of_levels_is_the_same_each_time(spark):
    data = [(i, "w " * (1 + i * 7 % 50), "en", ["big", "a", "b", "c"][0 if i % 3 else 1 + i % 9 // 3], 1) for i in range(3000)]
    docs = cases.table(spark, data)
    first = mixing.copies(mixing.mixing_units(docs), leaf_rows=10).select("doc_id", "copies").collect()
    again = mixing.copies(mixing.mixing_units(docs.repartition(7)), leaf_rows=10).select("doc_id", "copies").collect()
    assert sorted(first) == sorted(again)
    check(mixing.mix(docs).collect(), data)


def test_large_documents_leave_no_residual(spark):
    """A few very long documents among short ones: the words taken come as near as the shortest document allows."""
    import random

    r = random.Random(5)
    data = [(i, "w " * (r.randint(300, 900) if i % 97 == 0 else r.randint(1, 60)), "en", f"s{i % 5}", 1) for i in range(1500)]
    check(mixing.mix(cases.table(spark, data)).collect(), data)


def test_settling():
    hand = [{"extra": e, "words": w, "row": i, "doc_id": i} for i, (e, w) in enumerate([(0, 64), (0, 33), (1, 20), (0, 8), (0, 4), (1, 2), (0, 1), (0, 1)])]
    for missed in (0.0, 5.3, -21.0, 47.5, 100.0):
        left = missed - sum(f * hand[row]["words"] for row, _, f in mixing.settle(missed, hand))
        assert abs(left) <= 1 and (missed or left == 0)


def test_nothing_to_take(spark):
    rows = mixing.mix(cases.table(spark, [(1, "", "en", "a", 0), (2, None, None, None, None)])).collect()
    assert [(r.size, r.target, r.taken) for r in rows] == [(0, 0.0, 0)] * 2


def test_targets_of_many_shapes(spark):
    for sizes in ({"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 1000, None: 3, "é": 7}, {"a": 0, "b": 5}, {"x": 4}):
        df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
        got = {r.source: r.target for r in mixing.source_targets(df).collect()}
        assert got == pytest.approx(brute_targets(sizes))


def test_mixed_documents_keep_their_columns(spark):
    docs = cases.table(spark)
    out = mixing.mixed_documents(docs)
    assert out.columns == [*docs.columns, "mix_size", "mix_target", "mix_copies", "mix_taken"]
    clash = docs.withColumnsRenamed({"part": "mix_size", "cls": "__id", "grp": "MIX_TAKEN"})
    both = mixing.mixed_documents(clash)
    assert both.columns == [*clash.columns, "mix_size_", "mix_target", "mix_copies", "mix_taken_"] and both.count() == out.count()
    assert out.agg({"mix_taken": "sum"}).first()[0] == mixing.mix(docs).agg({"taken": "sum"}).first()[0]
