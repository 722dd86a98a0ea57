"""Quality rules: base counts of each text, and multivariate outliers per language and source.

The verdict is a robust one. Minimum-covariance-determinant estimates are found by concentration steps that run as
grouped aggregations: each step bins a group's rows by distance, keeps the closest `support` of them and takes their
mean and covariance. Several starts (medians and absolute deviations, and means and covariances of a few rows drawn by
hash) make two steps each; the one of least determinant goes on until its determinant falls no more. Groups and
starts share each pass; nothing of a group is gathered in one task, whatever its size. Bins and sums are whole
numbers, so that reruns agree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratewright.llm.common import cut, maybe_broadcast, slices

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"

#: The statistics of the vector, in order; see `vectors`.
DIMS = ("z_len", "z_symbol", "z_line", "z_repeat")

#: The least standard deviation of each statistic. Most texts have no symbol, repeated line or repeated words at all,
#: so a group's own spread is near 0 there, and a few of them must not make a text an outlier.
FLOORS = (0.1, 0.07, 0.12, 0.12)

BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeated_words(words: list[bytes], window: int = 3) -> int:
    """Words inside windows that the text has twice or more, the first included. Words go by number, so that a long text
    takes some tens of bytes for each of them."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
    key = ids[:n]
    for i in range(1, window):  # numbered anew at each step, so that keys stay below the square of the text's length
        key = np.unique(key * len(number) + ids[i : i + n], return_inverse=True)[1]
    often = np.bincount(key)[key] > 1
    if not often.any():
        return 0
    inside = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.flatnonzero(often)
    np.add.at(inside, at, 1)
    np.add.at(inside, at + window, -1)
    return int((np.cumsum(inside) > 0).sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; all 0 for null."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """`keep` columns and the base counts, in one pass over the texts and without a shuffle."""
    source = docs.select(*keep, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = np.array([base_counts(t) for t in part.column(part.num_columns - 1).to_pylist()], dtype=np.int64).reshape(-1, 5)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(pa.array(c) for c in found.T.copy())], names=[*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])

    return source.mapInArrow(run, f"{schema}, {BASE}")


def vectors() -> list[Column]:
    """The transformed statistics: near normal for prose of any length, so that length itself is no reason to reject."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    root = lambda part: F.asin(F.sqrt(F.least(part / n, F.lit(1.0))))  # noqa: E731  steadies the variance of a share
    return [
        F.log((F.col("word_chars") + 1) / n).alias("z_len"),
        root(F.col("n_symbols").cast("double")).alias("z_symbol"),
        root(F.col("n_dup_lines").cast("double")).alias("z_line"),
        root(F.col("n_repeat_words").cast("double")).alias("z_repeat"),
    ]


def cutoff(p: int, tail: float) -> float:
    """The chi-square value for `p` degrees of freedom with `tail` beyond it (p even: a finite sum), by bisection."""
    if p % 2:
        raise ValueError("p must be even")
    beyond = lambda x: math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(p // 2))
    low, high = 0.0, 1e4
    for _ in range(100):
        low, high = ((mid := (low + high) / 2), high) if beyond((low + high) / 2) > tail else (low, (low + high) / 2)
    return high


def inner_share(p: int, support: float) -> float:
    """What the covariance of the closest `support` of normal rows must be divided by to be that of all rows."""
    q = cutoff(p, 1 - support)
    closer = 1 - math.exp(-q / 2) * sum((q / 2) ** k / math.factorial(k) for k in range(p // 2 + 1))
    return closer / support


KEYS = ["g_lang", "g_source"]
FIT = "g_lang string, g_source string, start int, mean array<double>, inverse array<double>, logdet double, n long"

#: Bins of a statistic for each unit, and of a distance for each doubling: what is closer than that counts as a tie. Sums
#: are of whole numbers of these parts of a unit. Rows that make a start; starts besides the medians.
FINE, TIES, PARTS, ROWS_OF_START, STARTS = 256, 64, 1 << 20, 6, 3


def first_beyond(rows: DataFrame, keys: list[str], share: float) -> DataFrame:
    """`keys` and `within`: the least `bin` up to which a `share` of the rows of each group lies."""
    counts = rows.groupBy(*keys, "bin").agg(F.count("*").alias("held"))
    by = Window.partitionBy(*keys)
    placed = counts.withColumn("upto", F.sum("held").over(by.orderBy("bin"))).withColumn("all", F.sum("held").over(by))
    return placed.filter(F.col("upto") >= F.ceil(F.col("all") * share)).groupBy(*keys).agg(F.min("bin").alias("within"))


def medians(rows: DataFrame, values: list[Column]) -> DataFrame:
    """KEYS and at_0, at_1, ...: the median of each of `values` by group, to a 256th."""
    binned = rows.select(*KEYS, F.explode(F.array(*(F.struct(F.lit(i).alias("dim"), F.floor(v * FINE).alias("bin")) for i, v in enumerate(values)))).alias("x")).select(*KEYS, "x.dim", "x.bin")
    found = first_beyond(binned, [*KEYS, "dim"], 0.5)
    return found.groupBy(*KEYS).agg(*(F.max(F.when(F.col("dim") == i, (F.col("within") + 0.5) / FINE)).alias(f"at_{i}") for i in range(len(values))))


def starts(rows: DataFrame, floors: tuple[float, ...]) -> DataFrame:
    """FIT of each group and start, before any step."""
    p = len(DIMS)
    middle = cut(medians(rows, [F.col(d) for d in DIMS]), "mcd-start")
    about = rows.join(maybe_broadcast(middle), KEYS)
    spread = medians(about, [F.abs(F.col(d) - F.col(f"at_{i}")) for i, d in enumerate(DIMS)]).withColumnsRenamed({f"at_{i}": f"off_{i}" for i in range(p)})
    vector = F.array(*(F.col(d) for d in DIMS))
    drawn = [F.array(*(F.min_by(vector, F.xxhash64(*DIMS, F.lit(100 * k + j))) for j in range(ROWS_OF_START))) for k in range(STARTS)]
    held = rows.groupBy(*KEYS).agg(F.count("*").alias("n"), F.array(*drawn).alias("drawn"))
    table = held.join(middle, KEYS).join(spread, KEYS).select(*KEYS, "n", "drawn", F.array(*(F.col(f"at_{i}") for i in range(p))).alias("at"), F.array(*(F.col(f"off_{i}") for i in range(p))).alias("off"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for lang, source, n, drawn, at, off in zip(*(c.to_pylist() for c in b.columns), strict=True):
                out.append((lang, source, 0, at, np.diag((1.4826 * np.array(off)) ** 2 + np.square(floors)), n))
                for k, points in enumerate(np.array(drawn), 1):
                    out.append((lang, source, k, points.mean(axis=0).tolist(), np.cov(points.T, bias=True) + np.diag(np.square(floors)), n))
            if out:
                yield fitted(out)

    return cut(table.mapInArrow(run, FIT), "mcd-start")


def fitted(rows: list[tuple]) -> pa.RecordBatch:
    """FIT from (g_lang, g_source, start, mean, covariance, n); the floors on the diagonal keep covariances regular."""
    lang, source, start, mean, cov, n = zip(*rows, strict=True)
    columns = [lang, source, start, mean, [np.linalg.inv(c).ravel().tolist() for c in cov], [float(np.linalg.slogdet(c)[1]) for c in cov], n]
    kinds = [pa.string(), pa.string(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)], names=["g_lang", "g_source", "start", "mean", "inverse", "logdet", "n"])


def concentrated(rows: DataFrame, fit: DataFrame, support: float, floors: tuple[float, ...]) -> DataFrame:
    """FIT after one step: the mean and covariance of the `support` of rows that lie closest under `fit`."""
    p, keys = len(DIMS), [*KEYS, "start"]
    upper = [(i, j) for i in range(p) for j in range(i, p)]
    seen = rows.join(maybe_broadcast(fit), KEYS).withColumn("bin", F.floor(F.log2(F.greatest(distance(), F.lit(2.0**-40))) * TIES).cast("int"))
    within = cut(first_beyond(seen, keys, support), "mcd-within")
    close = seen.join(maybe_broadcast(within), keys).filter(F.col("bin") <= F.col("within"))
    whole = lambda v: F.sum(F.round(v * PARTS).cast("long"))
    moments = close.groupBy(*keys).agg(F.max("n").alias("n"), F.count("*").alias("m"), F.array(*(whole(F.col(d)) for d in DIMS)).alias("sums"), F.array(*(whole(F.col(DIMS[i]) * F.col(DIMS[j])) for i, j in upper)).alias("products"))
    scale = inner_share(p, support)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for lang, source, start, n, m, sums, products in zip(*(c.to_pylist() for c in b.columns), strict=True):
                mean = np.array(sums) / PARTS / m
                cov = np.zeros((p, p))
                for (i, j), x in zip(upper, products, strict=True):
                    cov[i, j] = cov[j, i] = x / PARTS / m - mean[i] * mean[j]
                out.append((lang, source, start, mean.tolist(), cov / scale + np.diag(np.square(floors)), n))
            if out:
                yield fitted(out)

    return cut(moments.select(*keys, "n", "m", "sums", "products").mapInArrow(run, FIT), "mcd")


def estimates(rows: DataFrame, support: float = 0.75, floors: tuple[float, ...] = FLOORS) -> DataFrame:
    """FIT of each group of `rows` (g_lang, g_source and the statistics): that of the least determinant found.

    The squares of `floors` are added to the variances. Rows of one bin of distance are all in or out. The number of
    groups bounds the tables that move; each pass reads the vectors once. Of equal determinants the first start counts. A group
    takes steps as long as its determinant falls, and keeps the estimate from before the step that didn't lower it; groups
    that have settled take no part in later passes.
    """
    fit = starts(rows, floors)
    for _ in range(2):
        fit = concentrated(rows, fit, support, floors)
    best = F.min_by(F.struct("start", "mean", "inverse", "logdet", "n"), F.struct("logdet", "start"))
    going = cut(fit.groupBy(*KEYS).agg(best.alias("b")).select(*KEYS, "b.*"), "mcd")
    settled = []
    while True:  # a determinant that falls has a least value above 0, and a step that isn't a fall ends its group
        after = concentrated(rows, going, support, floors)
        falling = after.join(going.select(*KEYS, F.col("logdet").alias("before")), KEYS).filter(F.col("before") - F.col("logdet") > 1e-6).drop("before")
        falling = cut(falling.select(*going.columns), "mcd-falling")
        settled.append(going.join(falling.select(*KEYS), KEYS, "left_anti"))
        if falling.isEmpty():
            return reduce(lambda x, y: x.unionByName(y), settled)
        going = falling


def distance() -> Column:
    """Squared Mahalanobis distance of the row's vector under its group's mean and inverse, inside generated code."""
    p = len(DIMS)
    off = [F.col(d) - F.col("mean")[i] for i, d in enumerate(DIMS)]
    return reduce(lambda a, b: a + b, (off[i] * off[j] * F.col("inverse")[i * p + j] for i in range(p) for j in range(p)))


def pools(rows: DataFrame, least_group: int) -> DataFrame:
    """(g_lang, g_source, feeds, e_lang, e_source): whose estimates the rows of a group feed, and whose judge it.

    A group of `least_group` rows judges itself; a smaller one is judged by all rows of its language, or by all rows
    of the table if those are fewer too. A pool is made only if some group needs it. "*" stands for any value.
    """
    keys = ["g_lang", "g_source"]
    groups = cut(rows.groupBy(*keys).agg(F.count("*").alias("size")), "quality-groups")
    langs = groups.groupBy("g_lang").agg(F.sum("size").alias("in_lang"), F.min("size").alias("least"))
    rare = not langs.filter(F.col("in_lang") < least_group).isEmpty()
    key = lambda lang, source: F.struct(lang.alias("g_lang"), source.alias("g_source"))
    own, of_lang, of_all = key(F.col("g_lang"), F.col("g_source")), key(F.col("g_lang"), F.lit("*")), key(F.lit("*"), F.lit("*"))
    large, spoken = F.col("size") >= least_group, F.col("in_lang") >= least_group
    feeds = F.array_compact(F.array(F.when(large, own), F.when(spoken & (F.col("least") < least_group), of_lang), F.when(F.lit(rare), of_all)))
    judge = F.when(large, own).when(spoken, of_lang).otherwise(of_all)
    return cut(groups.join(langs, "g_lang").select(*keys, feeds.alias("feeds"), judge["g_lang"].alias("e_lang"), judge["g_source"].alias("e_source")), "quality-pools")


def rate_quality(docs: DataFrame, tail: float = 1e-6, least_group: int = 20) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance.

    base_failed: fewer than 50 words, or over half of them in repeated 3-word windows. kept: not base_failed and
    within the chi-square distance that a normal row passes with probability `tail`. Estimates come from the rows
    that pass the base rules, per language and source (null is a value of its own); groups with fewer than
    `least_group` such rows are judged by those of their language, or of the whole table, so that every row that
    passes has a distance. Null and empty texts have 0 words and fail. Repeated rows each count
    and each give a row; an empty table gives none; columns beyond doc_id, text, lang and source are ignored.
    """
    keys = KEYS
    base = statistics(docs).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    base = base.select("*", F.concat(F.lit("="), F.col("lang")).alias("gl"), F.concat(F.lit("="), F.col("source")).alias("gs"), *vectors())
    base = cut(base.withColumns({"g_lang": F.coalesce("gl", F.lit("-")), "g_source": F.coalesce("gs", F.lit("-"))}).drop("gl", "gs", "lang", "source"), "quality")
    passed = base.filter(~F.col("base_failed")).select(*keys, *DIMS)
    pool = pools(passed, least_group)
    fed = passed.join(maybe_broadcast(pool.select(*keys, "feeds"), most=10_000), keys).select(F.explode("feeds").alias("feed"), *DIMS)
    fit = estimates(fed.select("feed.g_lang", "feed.g_source", *DIMS))
    fit = pool.drop("feeds").join(fit.select(F.col("g_lang").alias("e_lang"), F.col("g_source").alias("e_source"), "mean", "inverse"), ["e_lang", "e_source"]).select(*keys, "mean", "inverse")
    judged = base.join(maybe_broadcast(fit, most=10_000), keys, "left").withColumn("distance", distance())
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff(len(DIMS), tail))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance")
