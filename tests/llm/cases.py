"""Small tables with the odd rows that every operator must take: nulls, empty and long texts, ties, repeats, clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, part string, token string, cls string, n string, size string, grp string, blob string, found string"

SYLLABLES = ["the", "an", "er", "ti", "on", "re", "hé", "ñó", "st", "ou"]


def word(r):
    return "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 3)))


def prose(r, n):
    return " ".join(word(r) for _ in range(n))


def rows(seed=1, count=60):
    r = random.Random(seed)
    base = prose(r, 120)
    texts = [prose(r, r.randint(1, 200)) for _ in range(count)]
    texts += [base] * 4  # copies
    for _ in range(4):  # near copies
        w = base.split()
        w[r.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += ["", None, "   \n\t ", "one", "two words", "a b c d e", "#*$%&|<>", "日本語 の テキスト", "A B C", "x" * 3000, ("ab " * 4000).strip(), "line\nline\nline\n", "Case CASE case cAsE case", "<|endoftext|> mid <|endoftext|>", "it's we'll 12,345.67  \n\n end "]
    out = []
    for i, t in enumerate(texts):
        lang = r.choice(["en", "fr", None])
        out.append((i, t, lang, r.choice(["s1", "s1", "s2", None]), None if t is None else len(t)))
    out.append(out[0])  # a repeated row
    out.append((None, "a row without id " + prose(r, 60), "en", "s1", 5))
    return out


def table(spark, data=None):
    data = rows() if data is None else data
    return spark.createDataFrame([(*x, *["clash"] * 9) for x in data], SCHEMA)


def empty(spark):
    return table(spark, [])
