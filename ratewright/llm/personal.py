"""Personal data by bootstrapped contextual extraction, by DataFrame functions alone.

Identifiers that the base patterns find are seeds. They induce lexical patterns: the words around an identifier, its
shape (each digit a 9, letters an a, and whether a check digit holds), and one word with the shape. Patterns and the
instances they extract form a bipartite graph. Each round scores a pattern by how much of what it extracts is
believed to be of a kind, and an instance by its best pattern; patterns that stay trusted name identifiers that
no base pattern knows, such as those that a greedy base match has swallowed with their neighbours. An instance that
has the form of a kind and fails its check is known to be none: it counts against its patterns and is never
believed. The graph holds distinct (pattern, instance) pairs, aggregated before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewright.llm.common import cut, maybe_broadcast
from ratewright.llm.spans import Rule, bound, clear, gathered, joined, marked, matches, placed, reached, written


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits has a valid check digit: every second digit from the right counts double."""
    at = F.sequence(F.lit(1), F.length(number))

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(F.reverse(number), i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(at, F.lit(0), add) % 10 == 0


def is_card(match: Column) -> Column:
    return F.when(F.length(digits(match)).between(14, 19), luhn(digits(match))).otherwise(F.lit(False))


#: Matches equal those of the plain patterns: a run of a class is tried from its start only (or from where the
#: last match ended), and groups at the end repeat without going back, so long texts need neither time nor stack.
RULES = (
    Rule("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++"),
    Rule("ip", r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", lambda m: m.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$")),
    Rule("card", r"[0-9](?:[\x20-]?[0-9]){13,}+", is_card),
    Rule("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: F.length(digits(m)).between(10, 15)),
)

NUMBER = r"[+(]*+[0-9][0-9().+-]*+(?![0-9A-Za-z@])"

#: What may be an identifier: runs of number groups, one blank apart, and other tokens with a digit or an at sign. Each
#: is tried from its first character only.
CANDIDATES = (
    Rule("run", rf"(?<![0-9A-Za-z@().+-]){NUMBER}(?:\x20{NUMBER})*+"),
    Rule("word", r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"),
)

#: Code points on either side that are looked at for context; the least of a candidate; those of the longest with a shape;
#: groups of the longest part of a run that is tried by its shape.
REACH, LEAST, SHAPED, GROUPS = 48, 6, 64, 6

EDGES = ".,;:!?\"'()[]{}<>*#$%&|=_-"
OCCURRENCE = "array<struct<start:int,end:int,instance:string,seed:string,refuted:boolean,patterns:array<string>>>"


def contexts(left: Column, right: Column, shape: Column) -> list[Column]:
    """Patterns of a place: the two words before; the word before and the one after; either with the shape; the shape. Null
    without those words or the shape."""
    before, after = F.lower(left), F.lower(right)
    two = F.regexp_extract(before, r"(\S+)\s+(\S+)\s*$", 0)
    one = F.regexp_extract(before, r"(?:^|\s)(\S+)\s*$", 1)
    then = F.regexp_extract(after, r"^\s*(\S+)(?:\s|$)", 1)
    clean = lambda c: F.regexp_replace(F.trim(c), r"\s+", " ")
    return [
        F.when(two != "", F.concat(F.lit("L "), clean(two))), F.when((one != "") & (then != ""), F.concat(F.lit("B "), clean(one), F.lit(" _ "), clean(then))),
        F.when(one != "", F.concat(F.lit("l "), clean(one), F.lit(" "), shape)), F.when(then != "", F.concat(F.lit("r "), shape, F.lit(" "), clean(then))), F.concat(F.lit("S "), shape),
    ]


def refuted(instance: Column) -> Column:
    """Whether an instance has the form of a card, address or telephone number and fails its check."""
    n = F.length(digits(instance))
    card = instance.rlike(r"^[0-9](?:[\x20-]?[0-9])*+$") & n.between(14, 19) & ~is_card(instance)
    ip = instance.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$") & ~RULES[1].passes(instance)
    return card | ip | (instance.rlike(r"^\+[0-9][\x20().0-9-]+[0-9]$") & ~n.between(10, 15))


def shape_of(instance: Column) -> Column:
    """Digits as 9, runs of letters as a, and a mark if it has the form of a card with its check digit; null for long ones."""
    form = F.regexp_replace(F.regexp_replace(instance, "[0-9]", "9"), r"\p{L}+", "a")
    return F.when(F.length(instance) <= SHAPED, F.when(instance.rlike(r"^[0-9](?:[\x20-]?[0-9])*+$") & is_card(instance), F.concat(form, F.lit(" checked"))).otherwise(form))


def occurrence(start: Column, match: Column, left: Column | None, right: Column | None, seed: Column) -> Column:
    """A place of the graph; those without left and right are known by their shape alone. Long instances go by a hash."""
    low = F.lower(match)
    shape = shape_of(low)
    patterns = [F.concat(F.lit("S "), shape)] if left is None else contexts(left, right, shape)
    none = F.lit(None).cast("string")
    key = F.when(F.length(low) <= SHAPED, low).otherwise(F.sha2(low, 256))
    return F.struct(start.alias("start"), (start + F.length(match)).alias("end"), key.alias("instance"), F.coalesce(seed, none).alias("seed"), (seed.isNull() & refuted(low)).alias("refuted"), F.array_compact(F.array(*patterns)).alias("patterns"))


def trimmed(span: Column) -> Column:
    """A span without marks at either end; a closing bracket stays if its opening one is inside."""
    bare = F.ltrim(span["match"], F.lit(EDGES.replace("(", "")))
    cut_ = F.when(F.contains(bare, F.lit("(")), F.rtrim(bare, F.lit(EDGES.replace(")", "")))).otherwise(F.trim(bare, F.lit(EDGES)))
    start = span["start"] + F.length(span["match"]) - F.length(bare)
    return F.struct(start.alias("start"), cut_.alias("match"), span["left"].alias("left"), span["right"].alias("right"))


def parts_of_runs(runs: Column) -> Column:
    """(start, match) of every GROUPS groups at most that follow each other inside a run of two or more, but the whole run."""

    kind = "array<struct<start:int,match:string>>"

    def parts(run: Column) -> Column:
        def places(groups: Column) -> Column:
            def step(state: Column, i: Column) -> tuple[Column, Column, Column]:
                group = F.get(groups, i)
                return state + F.length(group) + 1, F.lit(True), F.struct(state.alias("start"), group.alias("group"))

            return gathered(F.size(groups), run["start"], step, "array<struct<start:int,group:string>>")

        def windows(at: Column) -> Column:
            some = lambda i, k: F.struct(F.get(at, i)["start"].alias("start"), F.array_join(F.transform(F.sequence(i, i + k - 1), lambda j: F.get(at, j)["group"]), " ").alias("match"))
            every = F.transform(F.sequence(F.lit(0), F.size(at) - 1), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(GROUPS), F.size(at) - i)), lambda k: F.when(k < F.size(at), some(i, k))))
            return F.filter(F.flatten(every), lambda w: w.isNotNull())

        return F.when(F.contains(run["match"], F.lit(" ")), bound(bound(F.split(run["match"], " "), places), windows)).otherwise(F.array().cast(kind))

    return F.flatten(F.transform(runs, parts))


def seeds(kind: str) -> Column:
    return F.transform(kind, lambda x: F.struct(*(x[c].alias(c) for c in ("start", "end", "match", "left", "right")), F.lit(kind).alias("seed")))


def base_spans(docs: DataFrame) -> DataFrame:
    """row, doc_id, a span array for each kind, and occ: base spans and other candidates with their patterns."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rules = (*RULES, *CANDIDATES)
    # one place for each search, so that a pattern isn't matched again wherever its result is used
    first = docs.select("doc_id", text.alias("text"), *(matches(text, r).alias(f"m_{r.kind}") for r in rules))
    second = first.select("doc_id", *(placed(F.col("text"), F.col(f"m_{r.kind}"), r, REACH).alias(r.kind) for r in rules))
    third = second.withColumn("base", F.concat(*(seeds(r.kind) for r in RULES)))
    long_ = lambda x: F.length(x["match"]) >= LEAST
    third = third.withColumn("runs", F.transform("run", trimmed)).withColumn("words", F.filter(F.transform("word", trimmed), lambda x: long_(x) & ~x["match"].rlike(r"^[+(]*[0-9][0-9().+-]*$")))
    fourth = third.withColumn("parts", parts_of_runs(F.col("runs")))
    none = F.lit(None).cast("string")
    def places(taken: Column) -> Column:
        free = lambda x: clear(taken, x["start"], x["start"] + F.length(x["match"]))
        whole = F.filter(F.concat(F.filter("runs", long_), "words"), free)
        return F.concat(
            F.transform("base", lambda x: occurrence(x["start"], x["match"], x["left"], x["right"], x["seed"])),
            F.transform(whole, lambda x: occurrence(x["start"], x["match"], x["left"], x["right"], none)),
            F.transform(F.filter("parts", lambda x: long_(x) & free(x)), lambda x: occurrence(x["start"], x["match"], None, None, none)),
        )

    occ = bound(reached(F.col("base")), places)
    return fourth.select("doc_id", *(r.kind for r in RULES), occ.cast(OCCURRENCE).alias("occ"))


def bootstrap(places: DataFrame, support: int = 3, trust: float = 0.7) -> DataFrame:
    """(instance, kind, confidence) of instances that trusted patterns extract and that aren't seeds.

    places: instance, seed (kind or null), refuted, patterns. A pattern is trusted for a kind if it extracts at least
    `support` believed instances of it, and they are at least `trust` of all that it extracts. Rounds go on until no
    belief changes. Beliefs are whole thousandths, rounded down, and never fall from round to round: the rounds end,
    and sums don't depend on their order.
    """
    every = cut(places.select("instance", "seed", "refuted", F.explode("patterns").alias("pattern")).groupBy("pattern", "instance").agg(F.max("seed").alias("seed"), F.max("refuted").alias("refuted")), "pii-edges")
    kinds = [r.kind for r in RULES]
    # a belief is 1 at most, so that a pattern of fewer instances than `support` can't be trusted in any round
    totals = cut(every.groupBy("pattern").agg(F.count("*").alias("n")).filter(F.col("n") >= support), "pii-totals")
    edges = cut(every.join(maybe_broadcast(totals.select("pattern")), "pattern"), "pii-graph")
    sums = [F.sum(f"s_{k}").alias(f"s_{k}") for k in kinds]
    seeded = cut(edges.filter(F.col("seed").isNotNull()).groupBy("pattern").agg(*(F.sum(F.when(F.col("seed") == k, 1000).otherwise(0)).alias(f"s_{k}") for k in kinds)), "pii-seeded")
    unseen = edges.filter(F.col("seed").isNull() & ~F.col("refuted")).select("pattern", "instance")
    believed, before = None, None
    while True:
        # whatever holds a seed or a believed instance takes part, whether or not a seed stands in it
        held = seeded if believed is None else seeded.unionByName(unseen.join(maybe_broadcast(believed), "instance").groupBy("pattern").agg(*(F.sum(f"b_{k}").alias(f"s_{k}") for k in kinds))).groupBy("pattern").agg(*sums)
        held = cut(held.filter(F.greatest(*(F.col(f"s_{k}") for k in kinds)) >= 1000 * support), "pii-held")
        scored = totals.join(maybe_broadcast(held), "pattern")
        score = lambda k: F.when((F.col(f"s_{k}") >= 1000 * support) & (F.col(f"s_{k}") / (1000 * F.col("n")) >= trust), F.floor(F.col(f"s_{k}") / (F.col("n") + 0.5))).otherwise(F.lit(0)).cast("long")
        trusted = cut(scored.select("pattern", *(score(k).alias(f"p_{k}") for k in kinds)).filter(F.greatest(*(F.col(f"p_{k}") for k in kinds)) > 0), "pii-trusted")
        believed = cut(unseen.join(maybe_broadcast(trusted), "pattern").groupBy("instance").agg(*(F.max(f"p_{k}").alias(f"b_{k}") for k in kinds)), "pii-believed")
        # as no belief ever falls, equal sums are equal beliefs
        now = believed.agg(F.count("*"), *(F.sum(f"b_{k}") for k in kinds)).first()
        if not now[0] or now == before:
            break
        before = now
    best = F.greatest(*(F.col(f"b_{k}") for k in kinds))
    kind = F.coalesce(*(F.when(F.col(f"b_{k}") == best, F.lit(k)) for k in kinds))
    return believed.select("instance", kind.alias("kind"), (best / 1000).alias("confidence"))


def find_personal(docs: DataFrame, support: int = 3, trust: float = 0.7) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added: a row for each row of `docs`.

    The counts and the digest are of base spans; `spans` holds the added ones too, which overlap neither them nor each
    other: of two that do, the one that begins first stays, or the longer. Null and empty texts have none. Repeated
    rows find the same; a pair of pattern and instance counts once however often it stands. Of two kinds equally
    believed the first as listed is taken. Candidates have LEAST code points or more; long ones have no shape. An
    empty table gives no rows; further columns are ignored. Spans are code points, end exclusive.
    """
    found = cut(base_spans(docs).withColumn("row", F.monotonically_increasing_id()), "pii")  # numbered once, as written
    places = found.select("row", F.explode("occ").alias("o")).select("row", "o.*")
    new = cut(bootstrap(places.select("instance", "seed", "refuted", "patterns"), support, trust), "pii-new")
    rank = F.create_map(*(x for i, r in enumerate(RULES) for x in (F.lit(r.kind), F.lit(i))))
    added = places.filter(F.col("seed").isNull()).join(maybe_broadcast(new), "instance")
    added = added.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", (-F.col("end")).alias("until"), rank[F.col("kind")].alias("rank"), "kind"))).alias("added"))

    def step(state: Column, i: Column) -> tuple[Column, Column, Column]:
        x = F.get("added", i)
        return F.greatest(state, -x["until"]), x["start"] >= state, F.struct(x["start"].alias("start"), x["rank"].alias("rank"), (-x["until"]).alias("end"), x["kind"].alias("kind"))

    added = added.select("row", gathered(F.size("added"), F.lit(0), step, "array<struct<start:int,rank:int,end:int,kind:string>>").alias("added"))
    kinds = [r.kind for r in RULES]
    every = F.concat(*(marked(F.col(k), i, k) for i, k in enumerate(kinds)))
    out = found.join(added, "row", "left")
    spans = F.when(F.col("added").isNull(), written(every)).otherwise(written(F.concat(every, F.col("added"))))
    return out.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in kinds), F.sha2(joined([(i, k, F.col(k)) for i, k in enumerate(kinds)]), 256).alias("base_sha256"), spans.alias("spans"), F.coalesce(F.size("added"), F.lit(0)).cast("long").alias("n_added"))
