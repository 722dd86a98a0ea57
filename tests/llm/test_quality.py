import re
from collections import Counter

import numpy as np
import pytest
from cases_path import cases

from ratewright.llm import quality


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(grams)
    inside = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside)


def test_base_counts(spark):
    data = cases.rows()
    found = quality.rate_quality(cases.table(spark)).collect()
    want = Counter()
    for i, t, *_ in data:
        b = brute(t)
        want[(i, *b, b[0] < 50 or 100 * b[4] > 50 * b[0])] += 1
    assert Counter(tuple(r)[:7] for r in found) == want
    assert all(not (r.kept and r.base_failed) for r in found)
    assert quality.rate_quality(cases.empty(spark)).count() == 0


def test_outliers_of_a_group_go_and_others_stay(spark):
    import random

    r = random.Random(3)
    data = [(i, cases.prose(r, r.randint(60, 400)), "en", "s1", 1) for i in range(200)]
    data += [(1000 + i, " ".join(w + "###***" for w in cases.prose(r, 200).split()), "en", "s1", 1) for i in range(20)]
    kept = {x.doc_id: x.kept for x in quality.rate_quality(cases.table(spark, data)).collect()}
    assert all(kept[i] for i in range(200))
    assert not any(kept[1000 + i] for i in range(20))


def test_outliers_by_repetition_and_by_lines(spark):
    import random

    r = random.Random(6)
    data = [(i, cases.prose(r, r.randint(60, 400)), "en", "s1", 1) for i in range(200)]
    for i in range(8):
        same = cases.prose(r, 45)
        data.append((1000 + i, f"{same} {cases.prose(r, 110)} {same}", "en", "s1", 1))  # 45 % of words, no line twice
        lines = [f"{w}{k}" for k, w in enumerate(cases.prose(r, 60).split())]
        data.append((2000 + i, "\n".join(r.sample(lines, 60) + r.sample(lines, 60)), "en", "s1", 1))  # each line twice, in another order
    rows = {x.doc_id: x for x in quality.rate_quality(cases.table(spark, data)).collect()}
    assert not any(x.base_failed for x in rows.values())
    assert {i for i, x in rows.items() if not x.kept} == {i for i in rows if i >= 1000}


def test_small_groups_are_judged_by_pools(spark):
    import random

    r = random.Random(4)
    good = lambda: cases.prose(r, r.randint(60, 400))
    bad = lambda: " ".join(w + "###***" for w in cases.prose(r, 200).split())
    data = [(i, good(), "en", "s1", 1) for i in range(60)]
    # a rare source, a rare language and groups of nulls, of 6 rows or fewer each
    for at, lang, source in ((100, "en", "s2"), (200, "fr", "s1"), (300, None, None), (400, "en", None)):
        data += [(at + i, good(), lang, source, 1) for i in range(5)] + [(at + 50, bad(), lang, source, 1)]
    rows = {x.doc_id: x for x in quality.rate_quality(cases.table(spark, data)).collect()}
    assert all(x.distance is not None for x in rows.values() if not x.base_failed)
    assert [i for i, x in rows.items() if not x.kept and not x.base_failed] == [i for i in rows if i % 100 == 50 and i > 100]


def test_estimates_approach_those_of_clean_rows(spark):
    rng = np.random.default_rng(5)
    clean = rng.normal(size=(2000, 4)) @ np.diag([1, 0.5, 0.2, 2]) + [3, 0, 1, -1]
    dirty = rng.normal(size=(300, 4)) + 30
    rows = spark.createDataFrame([("en", "s", *map(float, x)) for x in np.r_[clean, dirty]], "g_lang string, g_source string, " + ", ".join(f"{d} double" for d in quality.DIMS))
    fit = quality.estimates(rows, floors=(0.01,) * 4).first()
    assert np.allclose(fit["mean"], clean.mean(axis=0), atol=0.25)
    cov = np.linalg.inv(np.array(fit["inverse"]).reshape(4, 4))
    assert np.diag(cov) == pytest.approx(clean.var(axis=0), rel=0.35)


def test_chi_square_cutoff():
    assert quality.cutoff(4, 0.05) == pytest.approx(9.4877, abs=1e-3)
    assert quality.inner_share(4, 0.999999) == pytest.approx(1, abs=1e-3)


def brute_mcd(x, floors, support=0.75, seed=0, tries=200):
    """The least determinant over many random starts, each with steps to the end, over exact subsets."""
    rng, h, best = np.random.default_rng(seed), int(np.ceil(len(x) * support)), None
    scale, add = quality.inner_share(x.shape[1], support), np.diag(np.square(floors))
    for _ in range(tries):
        own = x[rng.choice(len(x), 6, replace=False)]
        mean, cov, last = own.mean(axis=0), np.cov(own.T, bias=True) + add, np.inf
        for _ in range(60):
            off = x - mean
            near = np.argsort(np.einsum("ij,jk,ik->i", off, np.linalg.inv(cov), off), kind="stable")[:h]
            mean, cov = x[near].mean(axis=0), np.cov(x[near].T, bias=True) / scale + add
            if (det := np.linalg.slogdet(cov)[1]) > last - 1e-9:
                break
            last = det
        if best is None or last < best[0]:
            best = last, mean, cov
    return best


@pytest.mark.parametrize("kind", ["one", "two"])
def test_estimates_against_brute_force(spark, kind):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(300, 4)) @ np.array([[1, 0.4, 0, 0], [0, 0.6, 0.2, 0], [0, 0, 0.5, 0], [0.3, 0, 0, 1]]) + [5, 2, 3, 4]
    x[:60] = rng.normal(size=(60, 4)) * 0.3 + ([9, 9, 9, 9] if kind == "one" else [5, 2, 9, 0])
    floors = (0.05,) * 4
    rows = spark.createDataFrame([("en", "s", *map(float, v)) for v in x], "g_lang string, g_source string, " + ", ".join(f"{d} double" for d in quality.DIMS))
    fit = quality.estimates(rows, floors=floors).first()
    logdet, mean, cov = brute_mcd(x, floors)
    assert fit["logdet"] <= logdet + 0.05  # ties of a bin are all in
    assert np.allclose(fit["mean"], mean, atol=0.05) and np.allclose(np.linalg.inv(np.array(fit["inverse"]).reshape(4, 4)), cov, atol=0.05)
    again = quality.estimates(rows.repartition(7), floors=floors).first()
    assert again["mean"] == fit["mean"] and again["logdet"] == fit["logdet"]


def test_no_group_takes_a_worse_step(spark):
    """Each group ends where a further step would not lower its determinant, whatever the others do."""
    rng = np.random.default_rng(3)
    data = []
    for k in range(6):
        x = rng.normal(size=(150 + 40 * k, 4)) * ([1, 0.4, 0.7, 2] if k % 2 else [0.2, 1, 1, 1])
        x[: 20 + 5 * k] += 4 + k
        data += [("en", f"s{k}", *map(float, v)) for v in x]
    rows = spark.createDataFrame(data, "g_lang string, g_source string, " + ", ".join(f"{d} double" for d in quality.DIMS))
    floors = (0.05,) * 4
    fit = quality.estimates(rows, floors=floors)
    ends = {x.g_source: x.logdet for x in fit.collect()}
    further = {x.g_source: x.logdet for x in quality.concentrated(rows, fit, 0.75, floors).collect()}
    assert len(ends) == 6 and all(further[k] > ends[k] - 1e-6 for k in ends)
    for k in ends:
        x = np.array([v[2:] for v in data if v[1] == k])
        assert ends[k] <= brute_mcd(x, floors, tries=60)[0] + 0.06


def test_repeated_words_of_long_texts():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 3, 4, 50, 400):
        words = [b"abc"[k : k + 1] for k in rng.integers(0, 3 if n < 60 else 2, n)]
        assert quality.repeated_words(words) == brute(b" ".join(words).decode())[4]
    assert quality.repeated_words([b"%d" % k for k in range(300_000)]) == 0
