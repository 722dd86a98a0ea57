import hashlib
import random
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from cases_path import cases
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ratewright.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
WORDS = bpe.Vocabulary(PATH)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def packed(text):
    return np.array(ids_of(text), dtype="<u4").tobytes()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=80), st.text(alphabet="aab 's\n\t1,é<|endoftext|>日", max_size=80), st.text(alphabet="etaoin", max_size=300)), max_size=6))
def test_any_texts(texts):
    found = bpe.Encoder(WORDS).of(texts)
    assert found == [packed(t) for t in texts]
    assert [WORDS.decoded(x) for x in found] == [LIBRARY.decode(ids_of(t), skip_special_tokens=False) for t in texts] == texts


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 50256), max_size=30))
def test_any_ids(ids):
    assert WORDS.decoded(np.array(ids, dtype="<u4").tobytes()) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_unknown_id():
    with pytest.raises(ValueError):
        WORDS.decoded(np.array([50257], dtype="<u4").tobytes())


def test_long_words_and_full_memory(monkeypatch):
    r = random.Random(3)
    texts = ["a" * 5001, "ab" * 3000, "é" * 999, " " * 777, "".join(r.choice("etaoinshr") for _ in range(4000)), cases.prose(r, 3000), "x<|endoftext|>" * 900, None, ""]
    monkeypatch.setattr(bpe, "WORDS_AT_ONCE", 50)
    monkeypatch.setattr(bpe, "REMEMBERED", 20)
    encoder = bpe.Encoder(WORDS)
    assert encoder.of(texts) == encoder.of(texts) == [packed(t) for t in texts]


def test_text_of_many_megabytes():
    text, began = " ".join(f"word{i % 5000} {i % 97}" for i in range(1_800_000)), time.process_time()
    assert len(text) > 19_000_000
    found = bpe.Encoder(WORDS).of([text])[0]
    assert WORDS.decoded(found) == text and time.process_time() - began < 60
    assert found[:400] == packed(text[:3000])[:400]


def test_table(spark):
    ids = bpe.encode(cases.table(spark), PATH)
    both = bpe.decode(ids, PATH).select("doc_id", "n_tokens", F.sha2("ids", 256), F.sha2("decoded", 256))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter((i, len(ids_of(t)), sha(packed(t)), sha((t or "").encode())) for i, t, *_ in cases.rows())
    assert Counter(map(tuple, both.collect())) == want
    assert bpe.decode(bpe.encode(cases.empty(spark), PATH), PATH).count() == 0
    assert bpe.decode(spark.createDataFrame([(None,)], "ids binary"), PATH).first().decoded is None
