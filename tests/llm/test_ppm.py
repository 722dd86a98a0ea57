import math
import zlib
from collections import Counter, defaultdict

import pytest
from cases_path import cases
from pyspark.sql import functions as F

from ratewright.llm import ppm
from ratewright.llm.common import crc_mod


class Brute:
    """Method C with exclusion, over plain dictionaries of contexts."""

    def __init__(self, texts, order):
        self.order, self.after = order, defaultdict(Counter)
        for t in texts:
            for i, b in enumerate(t):
                for k in range(min(i, order) + 1):
                    self.after[t[i - k : i]][b] += 1

    def score(self, text):
        out = 0.0
        for i, b in enumerate(text):
            gone = set()
            for k in range(min(i, self.order), -1, -1):
                seen = self.after.get(text[i - k : i])
                if not seen:
                    continue
                rest = {s: n for s, n in seen.items() if s not in gone}
                total, kinds = sum(rest.values()), len(rest)
                if b in rest:
                    out += math.log10(rest[b] / (total + kinds))
                    break
                if kinds:
                    out += math.log10(kinds / (total + kinds))
                gone |= set(seen)
            else:
                out -= math.log10(256 - len(gone))
        return out


def held(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2


@pytest.mark.parametrize(("order", "head"), [(4, 400_000), (4, 10), (2, 0)])
def test_scores(spark, order, head):
    data = cases.rows()
    docs = cases.table(spark).withColumn("train", crc_mod(F.col("doc_id"), 7) != 2)
    found = ppm.score_texts(docs, order=order, head_sequences=head, head_words=head).collect()
    train = [(t or "").encode() for i, t, *_ in data if not held(i)]
    count = Counter(w for t in train for w in [*t.lower().split(), None])
    n, v = sum(count.values()), len(count)
    trie = Brute(train, order)
    want = defaultdict(list)
    for i, t, *_ in data:
        t = (t or "").encode()
        tokens = [*t.lower().split(), None]
        want[i].append((held(i), len(tokens), sum(count[w] > 0 for w in tokens), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens), trie.score(t)))
    assert len(found) == len(data)
    for r in found:
        w = want[r.doc_id][0]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert r.base_score == pytest.approx(w[4], abs=1e-6)
        assert r.score == pytest.approx(w[5], abs=1e-6)


def test_no_rows_and_no_training(spark):
    docs = cases.empty(spark).withColumn("train", F.lit(True))
    assert ppm.score_texts(docs).count() == 0
    docs = cases.table(spark, [(1, "ab c", "en", "s", 4), (2, None, None, None, None)]).withColumn("train", F.lit(False))
    found = {r.doc_id: r for r in ppm.score_texts(docs).collect()}
    assert found[1].score == pytest.approx(4 * math.log10(1 / 256))
    assert (found[2].score, found[2].n_tokens, found[2].n_known) == (0.0, 1, 0)
