import random
from collections import Counter

from cases_path import cases  # noqa: F401  keeps the folder's layout in one place

from ratewright.llm import revisits

SCHEMA = "id long, url string, at long, full boolean, etag string, digest string, headers map<string,string>, span long, base string, canonical string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash", "clash") for r in rows], SCHEMA)


def test_canonical(spark):
    urls = ["http://WWW.Ex.com:80/a/b/?utm_source=x&b=2&a=1#top", "https://ex.com/a/b?a=1&b=2", "ex.com", "https://ex.com/", "https://ex.com/?ref=1", None, ""]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = [r[0] for r in df.select(revisits.canonical(df["url"])).collect()]
    assert got == ["ex.com/a/b?a=1&b=2", "ex.com/a/b?a=1&b=2", "ex.com", "ex.com", "ex.com", None, ""]


def brute(rows):
    out = Counter()
    for i, url, at, full, etag, digest, headers in rows:
        if full:
            continue
        base = max((r for r in rows if r[3] and url is not None and at is not None and r[1] == url and r[2] is not None and r[2] < at), key=lambda r: (r[2], r[0]), default=None)
        if base is None:
            status = "missing"
        elif etag is not None and base[4] is not None:
            status = "resolved" if etag == base[4] else "changed"
        elif digest is not None and base[5] is not None:
            status = "resolved" if digest == base[5] else "changed"
        else:
            status = "unchecked"
        own = headers or {}
        if status == "resolved":
            own = (base[6] or {}) | {k: v for k, v in own.items() if k.lower() in revisits.PERMITTED}
        out[(i, url, base and base[0], status, tuple(sorted(own.items())))] += 1
    return out


def test_against_brute_force(spark, monkeypatch):
    for span_rows in (5_000, 20):
        monkeypatch.setattr(revisits, "SPAN_ROWS", span_rows)
        r = random.Random(span_rows)
        rows = []
        for i in range(600):
            url = r.choice(["h.com/hot"] * 6 + ["b.com/1", "b.com/2", None])
            rows.append((i, url, r.choice([None, *range(200)]), r.random() < 0.4, r.choice(["e1", "e2", None]), r.choice(["d1", "d2", None]), r.choice([None, {}, {"date": str(i), "content-length": "9", "etag": "x"}])))
        rows.append(next(x for x in rows if not x[3]))
        got = Counter((x.id, x.canonical, x.base_id, x.status, tuple(sorted(x.headers.items()))) for x in revisits.resolve(frame(spark, rows)).collect())
        assert got == brute(rows)


def test_empty(spark):
    assert revisits.resolve(frame(spark, [])).count() == 0
