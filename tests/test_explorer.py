"""Decimal texts against fractions, neighbourhoods against a search in plain Python."""

import json
import random
from fractions import Fraction

from pyspark.sql import functions as F

from ratewright.functions import decimals
from ratewright.operators import explorer
from ratewright.plans.filings import store


def test_decimal_texts(spark):
    r = random.Random(1)
    texts = ["1.00000000000000001", "9007199254740991", "9007199254740992", "9007199254740991.0000001", "9007199254740991.000", "90071992547409910e-1", "0.9007199254740992e16", "1e400", "1e-400", "0e999999999999", "0.000", "1.5e1", "1.55e1", "-12.0", "+7", ".5", "5.", "00012", "9" * 40, "0." + "0" * 40 + "1", "10" * 30 + "e-30", "", " 12 ", "abc", "1e", ".", "1_0", "NaN", "0x10", None]
    texts += ["".join(r.choice("0019.") for _ in range(r.randint(1, 20))) + r.choice(["", "e3", "E-4", "e+12", "e-17"]) for _ in range(600)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = rows.select("t", decimals.is_number(F.col("t")).alias("n"), decimals.is_whole(F.col("t")).alias("w"), decimals.is_unsafe(F.col("t")).alias("u")).collect()
    import re

    for x in found:
        t = (x.t or "").strip(" ")
        number = bool(re.match(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$", t))
        assert x.n == number, x.t
        if not number:
            assert not x.w and not x.u
        elif t != "0e999999999999":
            v = Fraction(t)
            assert (x.w, x.u) == (v.denominator == 1, abs(v) > 2**53 - 1), x.t
        else:
            assert x.w and not x.u


def test_neighbourhoods(spark):
    s = store(spark, "/root/testdata/sf0.001")
    links = explorer.links_of(s, ("in_industry", "in_sector", "raises")).collect()
    around = {}
    for x in links:
        a, b = (x.source_kind, x.source), (x.target_kind, x.target)
        around.setdefault(a, set()).add(b)
        around.setdefault(b, set()).add(a)
    seeds = [("Filing", s.current("Filing").filter("flag_hours_missing").first().filing_id), ("Sector", "31"), ("Sector", "31"), ("Sector", "no such")]
    chosen = spark.createDataFrame([(k, str(v)) for k, v in seeds], "kind string, key string")
    nodes, edges = explorer.neighbourhood(s, chosen, 3, ("in_industry", "in_sector", "raises"))
    got = {}
    for x in nodes.collect():
        got.setdefault(x.seed, {})[x.kind, x.key] = x.distance
    for kind, key in seeds:
        want, front = {(kind, str(key)): 0}, {(kind, str(key))}
        for d in (1, 2, 3):
            front = {b for a in front for b in around.get(a, ())} - set(want)
            want |= dict.fromkeys(front, d)
        assert got[f"{kind}:{key}"] == want
    met = {(x.seed, x.link, x.source, x.target) for x in edges.collect()}
    assert met == {(seed, x.link, x.source, x.target) for seed, own in got.items() for x in links if (x.source_kind, x.source) in own and (x.target_kind, x.target) in own}
    made = {x.seed: json.loads(x.payload) for x in explorer.documents(nodes, edges).collect()}
    assert set(made) == set(got) and made["Sector:no such"] == {"nodes": [{"distance": 0, "kind": "Sector", "key": "no such"}], "edges": []}
    assert len(made["Sector:31"]["edges"]) == sum(1 for x in met if x[0] == "Sector:31")


def test_documents_hold_no_markup(spark):
    nodes = spark.createDataFrame([("a", "K", "</script>&", 0)], "seed string, kind string, key string, distance int")
    edges = spark.createDataFrame([], "seed string, link string, source_kind string, source string, target_kind string, target string")
    text = explorer.documents(nodes, edges).first().payload
    assert not {*"<>&"} & {*text} and json.loads(text)["nodes"][0]["key"] == "</script>&"
