import math
import random
from collections import Counter

import numpy as np
from cases_path import cases
from pyspark.sql import functions as F

from ratewright.llm import languages
from ratewright.llm.common import crc_mod

VOCABULARY = {"en": ["the", "and", "ing", "tion", "er", "th"], "de": ["der", "sch", "ung", "ein", "ü", "ch"], "fr": ["que", "eau", "ç", "ment", "les", "oi"]}


def corpus(n=240):
    r = random.Random(2)
    out = []
    for i in range(n):
        lang = r.choice([*VOCABULARY])
        text = " ".join("".join(r.choice(VOCABULARY[lang]) for _ in range(r.randint(1, 3))) for _ in range(r.randint(5, 120)))
        out.append((i, text, lang, "s", len(text)))
    return out


def test_held_out_accuracy_and_odd_rows(spark):
    data = [*corpus(), (900, None, "en", "s", 0), (901, "", "en", "s", 0), (902, "12 + 3 ***", None, "s", 9), (903, "der ein schung", None, None, 1), (904, "zz@@##!!0909~~ q^^^^" * 30, None, "s", 1)]
    docs = cases.table(spark, data)
    out = crc_mod(F.col("doc_id"), 4) == 2
    who = languages.fit(docs, ~out)
    assert who.names == ["de", "en", "fr"]
    found = {r.doc_id: r for r in languages.identify(docs, who).withColumn("held", out).collect()}
    held = [(i, lang) for i, _, lang, *_ in data[:240] if found[i].held]
    assert len(held) > 30
    assert np.mean([found[i]["__lang"] == lang for i, lang in held]) > 0.97
    for i in (900, 901, 902):
        assert (found[i]["__lang"], found[i]["__score"], found[i]["__rejected"]) == ("und", 0.0, True)
    assert found[903]["__lang"] == "de" and found[904]["__rejected"]
    assert sum(found[i]["__rejected"] for i in range(240)) <= 2
    assert all(0 <= r["__score"] <= 1 for r in found.values())


def test_tables_without_rows_or_labels(spark):
    who = languages.fit(cases.empty(spark), F.lit(True))
    assert languages.identify(cases.empty(spark), who).count() == 0
    rows = languages.identify(cases.table(spark), who).collect()
    assert {r["__lang"] for r in rows} == {"und"}


def test_probabilities_sum_to_one():
    """Over all next characters after a context, the model's probabilities sum to less than one, by what unknown ones get."""
    m = languages.Model(["abcab abd", "bcabdd", "ad cab"])
    chars = sorted(set("abcd ")) + [chr(int(languages.EDGE) - 1)]
    for context in ("ab", "ca", "zz", "d "):
        total = 0.0
        for ch in [*"abcd ", None]:
            flat = np.array([languages.EDGE, *map(ord, context), languages.EDGE if ch is None else ord(ch)], dtype=np.uint32)
            at = np.array([flat.size - 1])
            by = [languages.keys(flat, at, o) for o in range(1, languages.ORDER + 1)]
            ctx = [np.zeros(1, dtype=np.uint64), *(languages.keys(flat, at - 1, o) for o in range(1, languages.ORDER))]
            total += float(np.exp(m.log_probs(by, ctx))[0])
        assert 0.95 < total < 1.0001, (context, chars)


def kneser_ney(learned, order=languages.ORDER, alphabet=0x110000):
    """P(character | context) by dictionaries: top counts are of sequences, lower ones of the distinct characters before them."""
    edge = chr(0x10FFFF) + "#"  # a unit of its own
    units = [[edge] * (order - 1) + [*t.lower()] + [edge] for t in learned]
    top = Counter(tuple(u[i - order + 1 : i + 1]) for u in units for i in range(order - 1, len(u)))
    levels = {order: top}
    for o in range(order - 1, 0, -1):
        levels[o] = Counter(g[1:] for g in levels[o + 1])

    def p(gram):
        o = len(gram)
        if o == 0:
            return 1 / alphabet
        own = {g: c for g, c in levels[o].items() if g[:-1] == gram[:-1]}
        lower = p(gram[1:])
        if not own:
            return lower
        once, twice = (sum(c == k for c in levels[o].values()) for k in (1, 2))
        d = min(max(once / max(once + 2 * twice, 1), 0.1), 0.9)
        total = sum(own.values())
        return max(own.get(gram, 0) - d, 0) / total + d * len(own) / total * lower

    def entropy(text):
        u = [edge] * (order - 1) + [*text.lower()] + [edge]
        return -sum(math.log(p(tuple(u[i - order + 1 : i + 1]))) for i in range(order - 1, len(u))) / (len(text) + 1)

    return entropy


def test_entropies_against_brute_force():
    r = random.Random(3)
    texts = [" ".join("".join(r.choice(VOCABULARY[v]) for _ in range(r.randint(1, 3))) for _ in range(r.randint(1, 12))) for v in ("en", "de", "fr") for _ in range(8)]
    models = {v: texts[8 * k : 8 * k + 6] for k, v in enumerate(("en", "de", "fr"))}
    who = languages.Identifier([*models], [languages.Model(t) for t in models.values()])
    asked = [*texts, "x", "ZZ the zz", "日本 the", "a"]
    want = [[kneser_ney(t)(a) for t in models.values()] for a in asked]
    assert np.allclose(who.entropies(asked), want, rtol=1e-9)
    assert [p[0] for p in who.predict(asked)] == [[*models][int(np.argmin(w))] for w in want]


def test_languages_that_were_not_learned_are_rejected(spark):
    """Texts of a learned language are rejected about as rarely as stated; those of another one nearly always."""
    data = corpus(1500)
    docs = cases.table(spark, [x for x in data if x[2] != "fr"])
    out = crc_mod(F.col("doc_id"), 4) == 2
    who = languages.fit(docs, ~out)
    own = languages.identify(docs.filter(out), who).collect()
    assert sum(r["__rejected"] for r in own) <= max(2, 2 * languages.FALSE_REJECTIONS * len(own))
    other = languages.identify(cases.table(spark, [x for x in data if x[2] == "fr"]), who).collect()
    assert sum(r["__rejected"] for r in other) > 0.95 * len(other)


def test_sample_takes_one_text_of_each_id(spark):
    data = [(i % 20, f"text {i}", "en", "s", 1) for i in range(100)] + [(None, f"no id {i}", "en", "s", 1) for i in range(5)] + [(7, None, "en", "s", 1), (500, "x" * 900, "de", "s", 1), (501, "y" * 900, "de", "s", 1)]
    docs = cases.table(spark, data)
    sample = languages.labelled_sample(docs, F.lit(True), 15, 1000).collect()
    assert sorted(r.k for r in sample if r.lang == "en") == list(range(1, 16)) and len([r for r in sample if r.lang == "de"]) == 1
    every = languages.labelled_sample(docs, F.lit(True), 50, 10**6).collect()
    assert len([r for r in every if r.lang == "en"]) == 21
