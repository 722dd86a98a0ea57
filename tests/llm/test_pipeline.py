import random
from collections import Counter, defaultdict

import corpus_pipeline as p
import test_contamination
import test_jaccard
import test_mixing
from cases_path import cases
from test_spans import SECRET, spans

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def corpus(r, item):
    data = cases.rows(count=60)
    data += [(800, f"{item} and more", "en", "s1", 1), (801, "token = 0123456789abcdef " + cases.prose(r, 80), "en", "s2", 1), (802, f"{cases.prose(r, 700)} {item}", "fr", "s2", 1)]
    same = cases.prose(r, 90)
    return data + [(810, same, "en", "s1", 1), (810, same, "en", "s1", 1), (None, same + " end", "en", None, 1), (811, None, None, None, None), (812, "", "en", "s1", 0), (813, "x" * 200_000 + " " + cases.prose(r, 30), "en", "s1", 1)]


def write(spark, folder, data, items):
    cases.table(spark, data).select(*COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_stages_against_brute_force(spark, tmp_path):
    """Each stage on what its predecessor wrote, repeated rows, nulls and a very long text among it."""
    r = random.Random(1)
    item = cases.prose(r, 30)
    write(spark, tmp_path, corpus(r, item), [(1, item), (2, None), (None, "no id")])
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    before = {}
    for name, stage in p.STAGES:
        before[name] = [tuple(x) for x in now.collect()]
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = now.collect()
        if name != p.STAGES[-1][0]:
            assert tuple(now.columns) == COLUMNS
    rows = lambda name: Counter(tuple(x)[:5] for x in seen[name])
    # languages: a part of the rows, none without letters; nothing is changed
    assert rows("language_id") <= Counter(before["language_id"]) and len(seen["language_id"]) >= 60
    assert not [x for x in seen["language_id"] if not x.text or not any(map(str.isalpha, x.text))]
    # near duplicates: one row of each component, of its least id
    data = before["near_duplicates"]
    groups = defaultdict(list)
    for (i, n, c), t in zip(test_jaccard.labelled(data), data, strict=True):
        groups[c].append((i is None, i or 0, n, t))
    kept = Counter(x.doc_id for x in seen["near_duplicates"])
    assert kept == Counter(None if min(g)[0] else min(g)[1] for g in groups.values())
    assert rows("near_duplicates") <= Counter(data)
    # benchmark passages: exactly the rows that the contract calls clean
    items = [(1, item), (2, None), (None, "no id")]
    assert rows("decontamination") == Counter(x for x in before["decontamination"] if not test_contamination.brute(x[1], items)[4])
    assert 800 not in {x.doc_id for x in seen["decontamination"]} and {802} & {x[0] for x in before["decontamination"]} <= {x.doc_id for x in seen["decontamination"]}
    # secrets: every row stays, and is changed only if it has some
    assert Counter(x.doc_id for x in seen["secret_scan"]) == Counter(x[0] for x in before["secret_scan"])
    clean = Counter(x for x in before["secret_scan"] if not any(spans(x[1], SECRET).values()))
    assert clean <= rows("secret_scan") and "0123456789abcdef" not in "".join(x.text for x in seen["secret_scan"])
    # mix: words of each source near its target, no document more than three times
    sizes, taken = defaultdict(int), defaultdict(int)
    for x in before["source_mix"]:
        sizes[x[3]] += test_mixing.words(x[1])
    for x in seen["source_mix"]:
        assert 0 < x.mix_copies <= 3 and x.mix_taken == x.mix_copies * test_mixing.words(x.text)
        taken[x.source] += x.mix_taken
    largest = max(test_mixing.words(x[1]) for x in before["source_mix"])
    assert all(abs(taken[s] - t) <= largest for s, t in test_mixing.brute_targets(dict(sizes)).items())


def test_empty_tables(spark, tmp_path):
    write(spark, tmp_path, [], [])
    assert p.run(spark, str(tmp_path)).count() == 0
