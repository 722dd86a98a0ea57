import random
import time

import public_tokenizers
from cases_path import cases
from collections import Counter
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ratewright.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
COUNTS = tokens.Counts(tokens.Merges(PATH))


def library(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_any_text(text):
    assert COUNTS.of([text]) == [library(text)]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aab 's\n\t1,é<|endoftext|>日", max_size=120))
def test_repeats_and_edges(text):
    assert COUNTS.of([text]) == [library(text)]


def test_long_run():
    for text in ("a" * 5001, "ab" * 3000, "é" * 999, " " * 777, "=-" * 1200):
        assert COUNTS.of([text]) == [library(text)]


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="aabcdetionsrh", min_size=1, max_size=400), st.integers(1, 3))
def test_long_sequences_against_the_library(text, times):
    text = (text * (3000 // len(text) * times + 1))[: 1500 * times]
    assert COUNTS.of([text]) == [library(text)]


def test_time_of_a_very_long_run():
    r, began = random.Random(1), time.process_time()
    text = "".join(r.choice("etaoinshrdlucmfw") for _ in range(200_000))
    found = tokens.Counts(COUNTS.merges).of([text])
    assert time.process_time() - began < 20  # under 2 s on an idle core; 29 s before
    assert found == [library(text)]


def test_table(spark):
    found = tokens.count_tokens(cases.table(spark), PATH).collect()
    want = Counter((i, len((t or "").encode()), n := library(t), n > 512) for i, t, *_ in cases.rows())
    assert Counter(map(tuple, found)) == want
    assert tokens.count_tokens(cases.empty(spark), PATH).count() == 0
