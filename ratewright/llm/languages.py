"""Language identification by interpolated Kneser-Ney character models, one per language.

Each model lies in sorted arrays of 64-bit hashes of character sequences, with the interpolated log probability
of each sequence seen and the back-off weight of each context. A text gets the language of the lowest
cross-entropy per character; it is rejected if that entropy lies further above the language's own than held-back
training texts do, measured in the deviations that a text of its length has. Training reads a bounded sample of labelled
rows; every row is predicted, from its whole text.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratewright.llm.common import CHUNK_BYTES, collected, cut, hashed64, maybe_broadcast, slices, tidy

#: Characters of the longest sequence; labelled texts of each language that are counted, and that calibrate it.
ORDER, TRAIN_ROWS, CALIBRATION_ROWS = 4, 600, 200

#: Characters of the sample of a language: what a task that learns it holds at most, if no single text is longer.
SAMPLE_CHARS = 32_000_000

#: Of texts in a learned language, the share that may be rejected; and a margin on the deviation that so few exceed.
FALSE_REJECTIONS, MARGIN = 0.005, 1.5

EDGE = np.uint32(0x110000)  # stands before and after a text
BASE = np.uint64(0x9E3779B97F4A7C15)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(characters with edges before each text, index of the text of each character to score, where those stand)."""
    parts, lengths = [], []
    for t in texts:
        own = np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        parts += [np.full(ORDER - 1, EDGE, dtype=np.uint32), own, np.full(1, EDGE, dtype=np.uint32)]
        lengths.append(own.size + 1)
    flat = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint32)
    n = np.array(lengths, dtype=np.int64)
    text = np.repeat(np.arange(n.size), n)
    return flat, text, np.arange(text.size) + (text + 1) * (ORDER - 1)


def keys(flat: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
    """Hashes of the `order` characters that end at each place. Hashes of different lengths don't meet but by chance."""
    h = np.full(at.size, order, dtype=np.uint64)
    for k in range(order - 1, -1, -1):
        h = h * BASE + flat[at - k].astype(np.uint64) + np.uint64(1)
    return hashed64(h)


class Model:
    """Tables by order: sorted hashes with log probabilities, and sorted hashes of contexts with log back-offs."""

    def __init__(self, texts: list[str], alphabet: int = 0x110000):
        flat, _, at = code_points(texts)
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []
        self.backs: list[tuple[np.ndarray, np.ndarray]] = []
        # distinct sequences of the top order, with their counts; lower orders count the distinct characters before
        whole, first, count = np.unique(keys(flat, at, ORDER), return_index=True, return_counts=True)
        where, count = at[first], count.astype(np.float64)
        levels = [(where, count)]
        for order in range(ORDER - 1, 0, -1):
            _, first, seen = np.unique(keys(flat, where, order), return_index=True, return_counts=True)
            where = where[first]
            levels.append((where, seen.astype(np.float64)))
        self.unknown = -np.log(float(alphabet))
        below = None
        for order, (where, count) in enumerate(reversed(levels), 1):
            own = keys(flat, where, order)
            context = keys(flat, where - 1, order - 1) if order > 1 else np.zeros(where.size, dtype=np.uint64)
            contexts, of = np.unique(context, return_inverse=True)
            total = np.bincount(of, weights=count)
            kinds = np.bincount(of)
            once, twice = (count == 1).sum(), (count == 2).sum()
            d = min(max(once / max(once + 2 * twice, 1), 0.1), 0.9)
            back = d * kinds / total
            lower = np.full(where.size, np.exp(self.unknown)) if below is None else np.exp(below(keys(flat, where, order - 1)))
            p = (count - d) / total[of] + back[of] * lower
            order_of = np.argsort(own)
            self.grams.append((own[order_of], np.log(p[order_of])))
            self.backs.append((contexts, np.log(back)))
            table = self.grams[-1]
            below = lambda k, t=table: t[1][np.searchsorted(t[0], k)]  # noqa: E731  every suffix of a seen sequence is seen

    def log_probs(self, by_order: list[np.ndarray], contexts: list[np.ndarray]) -> np.ndarray:
        """Natural log probability of the last character, from the hashes of each order and of their contexts."""
        out = np.full(by_order[0].size, self.unknown)
        for order in range(1, ORDER + 1):
            known, value = self.grams[order - 1]
            at = np.minimum(np.searchsorted(known, by_order[order - 1]), known.size - 1)
            seen = known[at] == by_order[order - 1]
            held, weight = self.backs[order - 1]
            where = np.minimum(np.searchsorted(held, contexts[order - 1]), held.size - 1)
            backed = np.where(held[where] == contexts[order - 1], weight[where], 0.0)
            out = np.where(seen, value[at], out + backed)
        return out


class Identifier:
    """All models, and what texts of each language reach: the median entropy, its deviation between long texts, and that of
    single characters. `bound`: the deviations beyond which a text is rejected. `sharp`: of scores."""

    def __init__(self, names: list[str], models: list[Model]):
        self.names, self.models = names, models
        self.median, self.between, self.single = (np.zeros(len(names)) for _ in range(3))
        self.bound, self.sharp = float("inf"), 1.0

    def deviations(self, entropy: np.ndarray, best: np.ndarray, length: np.ndarray) -> np.ndarray:
        """How far entropies lie above the median of language `best`, for texts of `length` characters."""
        spread = np.sqrt(self.between[best] ** 2 + self.single[best] ** 2 / (length + 1))
        return (entropy - self.median[best]) / np.maximum(spread, 1e-9)

    def character_spread(self, texts: list[str], i: int) -> float:
        """The standard deviation of a character's surprisal under language `i`."""
        flat, _, at = code_points(texts)
        by_order = [keys(flat, at, o) for o in range(1, ORDER + 1)]
        contexts = [np.zeros(at.size, dtype=np.uint64), *(keys(flat, at - 1, o) for o in range(1, ORDER))]
        return float(self.models[i].log_probs(by_order, contexts).std())

    def entropies(self, texts: list[str]) -> np.ndarray:
        """Nats per character (the end counted) of each text under each language: each distinct sequence is looked up once."""
        flat, text, at = code_points(texts)
        top = keys(flat, at, ORDER)
        distinct, first = np.unique(top, return_index=True)
        by_order = [keys(flat, at[first], o) for o in range(1, ORDER + 1)]
        contexts = [np.zeros(first.size, dtype=np.uint64), *(keys(flat, at[first] - 1, o) for o in range(1, ORDER))]
        where = np.searchsorted(distinct, top)
        n = np.bincount(text, minlength=len(texts))
        return np.stack([-np.bincount(text, weights=m.log_probs(by_order, contexts)[where], minlength=len(texts)) / n for m in self.models], axis=1)

    def calibrate(self, held_back: list[list[str]], false_rejections: float) -> None:
        """Sets the bound and the sharpness from texts of each language that it was not learned from."""
        gaps, beyond = [], []
        for i, texts in enumerate(held_back):
            h = np.concatenate([self.entropies(texts[k : k + 50]) for k in range(0, len(texts), 50)])
            own, length = h[:, i], np.array([len(t) for t in texts])
            self.median[i] = np.median(own)
            self.between[i] = 1.4826 * np.median(np.abs(own - self.median[i]))
            self.single[i] = self.character_spread(texts[:50], i)
            beyond.append(self.deviations(own, np.full(own.size, i), length))
            gaps.append((i, np.sqrt(length + 1.0)[:, None] * (h - h.min(axis=1, keepdims=True))))
        if beyond:
            z = np.sort(np.concatenate(beyond))
            self.bound = MARGIN * max(float(z[min(z.size - 1, int(np.ceil((z.size + 1) * (1 - false_rejections))) - 1)]), 4.0)
        if len(self.names) > 1:
            loss = lambda s: -sum(float((-s * g[:, i] - np.log(np.exp(-s * g).sum(axis=1))).sum()) for i, g in gaps)
            self.sharp = min((0.05, 0.1, 0.2, 0.5, 1, 2, 4), key=loss)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float | None, bool]]:
        """(language, score, entropy, rejected) of each text."""
        out: list[tuple[str, float, float | None, bool]] = [("und", 0.0, None, True)] * len(texts)
        lettered = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        if not lettered or not self.models:
            return out
        h = self.entropies([texts[i] or "" for i in lettered])
        best = h.argmin(axis=1)
        low = h[np.arange(best.size), best]
        length = np.array([len(texts[i] or "") for i in lettered])
        score = 1 / np.exp(-self.sharp * np.sqrt(length + 1.0)[:, None] * (h - low[:, None])).sum(axis=1)
        rejected = self.deviations(low, best, length) > self.bound
        for k, i in enumerate(lettered):
            b = int(best[k])
            out[i] = (self.names[b], float(score[k]), float(low[k]), bool(rejected[k]))
        return out


def labelled_sample(docs: DataFrame, train: object, rows: int, chars: int = SAMPLE_CHARS) -> DataFrame:
    """lang, k, text: at most `rows` texts of each language with `chars` characters in all (or one text), by the least hash.

    Ids and lengths are ranked before texts are read. Hashes that lie well above the share that is wanted of a language
    are passed over before its rows are ranked; should too few be left of one, all of its rows are ranked. Of rows that
    share an id and a language one text is taken, of rows without an id too.
    """
    known = docs.filter(train & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0))
    known = known.select("doc_id", "lang", (F.xxhash64("doc_id") / 2.0**64 + 0.5).alias("u"), F.length("text").cast("long").alias("chars"))
    sizes = known.groupBy("lang").agg(F.count("*").alias("n")).withColumn("share", F.lit(rows + 8 * rows**0.5 + 20) / F.col("n"))
    sizes = cut(sizes, "languages")
    near = known.join(maybe_broadcast(sizes), "lang").filter(F.col("u") <= F.col("share"))
    enough = cut(near.groupBy("lang").agg(F.count_distinct("doc_id").alias("left"), F.max("n").alias("n")).filter((F.col("left") >= rows) | (F.col("left") == F.col("n"))), "languages")
    near = near.join(maybe_broadcast(enough.select("lang")), "lang", "left_semi").select("doc_id", "lang", "u", "chars")
    rest = known.join(maybe_broadcast(enough.select("lang")), "lang", "left_anti")
    once = near.unionByName(rest).groupBy("lang", "doc_id", "u").agg(F.min("chars").alias("chars"))
    order = Window.partitionBy("lang").orderBy("u", "doc_id")
    top = once.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= rows).withColumn("held", F.sum("chars").over(order))
    top = cut(top.filter((F.col("held") <= chars) | (F.col("k") == 1)).select(F.col("doc_id").alias("id"), F.col("lang").alias("of"), "k", "chars"), "languages")
    same = docs["doc_id"].eqNullSafe(F.col("id")) & (docs["lang"] == F.col("of")) & (F.length(docs["text"]) == F.col("chars"))
    return docs.select("doc_id", "lang", "text").join(maybe_broadcast(top), same).select("lang", "k", "text").dropDuplicates(["lang", "k"])


def fit(docs: DataFrame, train: object, train_rows: int = TRAIN_ROWS, calibration_rows: int = CALIBRATION_ROWS, false_rejections: float = FALSE_REJECTIONS) -> Identifier:
    """Models of all languages that `train` rows of `docs` are labelled with.

    Each language is learned in a task of its own from at most `train_rows` texts; `calibration_rows` further
    ones give the entropies it reaches on texts not counted (half of those seen do, if there are too few). The
    bound on deviations is MARGIN times the one that `false_rejections` of all calibration texts exceed. The
    models come to the driver: their size follows the sample's, not the corpus.
    """
    sample = labelled_sample(docs, train, train_rows + calibration_rows)

    def packed(texts: list[str]) -> bytes:
        learned = texts[:-min(calibration_rows, len(texts) // 4)] if len(texts) >= 4 else texts
        return pickle.dumps((Model(learned), texts[len(learned):] or texts))

    def learn_table(table: pa.Table) -> pa.Table:
        table = table.sort_by("k")
        return pa.table({"lang": table.column("lang").slice(0, 1), "model": pa.array([packed(table.column("text").to_pylist())], type=pa.binary())})

    found = collected(sample.groupBy("lang").applyInArrow(learn_table, "lang string, model binary")).sort_by("lang")
    unpacked = [pickle.loads(x) for x in found.column("model").to_pylist()]  # noqa: S301  our own bytes
    who = Identifier(found.column("lang").to_pylist(), [m for m, _ in unpacked])
    who.calibrate([texts for _, texts in unpacked], false_rejections)
    return who


def identify(docs: DataFrame, who: Identifier, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns with __lang, __score, __entropy and __rejected; only texts are looked at. Nothing is shuffled.

    Null texts and texts without a letter are `und`, with score 0, and rejected; so are all if no language was
    learned. Of equally low entropies the first language by name is given. Every row gives a row, repeated ones
    too; an empty table gives none; further columns are passed on only if `keep` names them.
    """
    shared = docs.sparkSession.sparkContext.broadcast(who)
    names = list(keep)
    schema = docs.select(*names).schema
    for n, t in (("__lang", "string"), ("__score", "double"), ("__entropy", "double"), ("__rejected", "boolean")):
        schema = schema.add(n, t)
    texts = docs.select(*names, *([] if "text" in names else ["text"]))
    at = texts.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", CHUNK_BYTES // 2):
                lang, score, entropy, rejected = zip(*shared.value.predict(part.column(at).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(lang), pa.array(score), pa.array(entropy, type=pa.float64()), pa.array(rejected)], names=[*names, "__lang", "__score", "__entropy", "__rejected"])

    return texts.mapInArrow(tidy(run), schema)
