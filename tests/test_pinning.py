"""Sums without cancellation, joins that must be one to one, results bound to their inputs."""

import gzip
import hashlib
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from ratewright.operators import influence, merge, review
from ratewright.operators.without import sums_without
from ratewright.plans import filings
from ratewright.sources import manifest


def test_a_row_that_holds_nearly_everything(spark):
    """One row has 99.9999999999 % of the hours: total - row would leave noise."""
    r = random.Random(4)
    rows = [("y", i, r.uniform(0.001, 0.01), float(r.randrange(3))) for i in range(3000)] + [("y", 5000, 1e17, 7.0), ("z", 1, 3.0, 1.0), (None, 2, 4.0, None), (None, 3, 5.0, 2.0)]
    df = spark.createDataFrame(rows, "g string, id long, hours double, cases double").repartition(7)
    found = {(x.g, x.id): x for x in sums_without(df, "g", "id", ("hours", "cases"), rows=100).collect()}
    assert len(found) == len(rows)
    for g, i in (("y", 0), ("y", 17), ("y", 2999), ("y", 5000), ("z", 1), (None, 2), (None, 3)):
        want = float(sum((Fraction(x[2]) for x in rows if x[0] == g and x[1] != i), Fraction(0)))
        assert found[g, i].without_hours == pytest.approx(want, rel=1e-12)
    assert found[None, 2].without_cases == 2 and found[None, 3].without_cases == 0
    assert sums_without(df.filter("false"), "g", "id", ("hours",)).count() == 0
    alone = {x.g: x for x in sums_without(df.filter("g = 'z'"), "g", "id", ("hours",)).collect()}
    assert alone["z"].without_hours == 0 and alone["z"].all_hours == 3


def test_no_task_reads_a_group(spark):
    """Two groups of 4,000 rows over 16 partitions: whichever way the rows are moved, they are dealt over all tasks."""
    spark.range(8000).select((F.col("id") % 2).alias("g"), "id", F.lit(1.0).alias("x")).createOrReplaceTempView("two_groups")
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in settings}
    context = spark.sparkContext
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        context.setJobGroup("no task reads a group", "")
        out = sums_without(spark.table("two_groups"), "g", "id", ("x",), rows=100).collect()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(out) == 8000 and {(x.without_x, x.all_x) for x in out} == {(3999.0, 4000.0)}
    store, tracker = context._jsc.sc().statusStore(), context.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("no task reads a group") for s in tracker.getJobInfo(j).stageIds}
    tasks = [t for s in stages for found in [store.taskList(s, 0, 1000)] for t in map(found.apply, range(found.size()))]
    read = [t.taskMetrics().get().shuffleReadMetrics().recordsRead() for t in tasks if t.taskMetrics().isDefined()]
    assert 100 < max(read) < 2000


def test_review_of_a_dominant_row(spark):
    data = [(2023, 10.0, 20000.0 + i, float(i % 3), f"a{i}") for i in range(50)] + [(2024, 10.0, 21000.0 + i, float(i % 4), f"a{i}") for i in range(50)] + [(2024, 1e13, 2e16, 0.0, "big")]
    out = {x.key: x for x in review.analyse(spark.createDataFrame(data, "year int, employees double, hours double, cases double, filing_id string")).collect()}
    rest = [x for x in data if x[0] == 2024 and x[4] != "big"]
    assert out["2024:big"].rate_without == pytest.approx(200_000 * sum(x[3] for x in rest) / sum(x[2] for x in rest), rel=1e-13)
    assert sorted(x.rank for k, x in out.items() if x.year == 2024) == list(range(1, 52)) and out["2024:big"].rank == 1
    rows = {x.scenario: x for x in review.scenario_rows(review.analyse(spark.createDataFrame(data, "year int, employees double, hours double, cases double, filing_id string"), excluded=("2024:big",))).collect()}
    assert rows["loaded"].rate_to == rows["screened"].rate_to < 1e-3 < rows["reviewed"].rate_to == pytest.approx(rows["without_most_influential"].rate_to)


def test_one_to_one(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, a string")
    b = spark.createDataFrame([(2, 5.0), (1, 4.0)], "k int, b double")
    assert sorted(map(tuple, merge.one_to_one(a, b, ["k"]).collect())) == [(1, "x", 4.0), (2, "y", 5.0)]
    with pytest.raises(merge.MergeError) as e:
        merge.one_to_one(a.unionByName(a.limit(1)), b, ["k"])
    assert e.value.found == {"repeated_left": 1}
    with pytest.raises(merge.MergeError) as e:
        merge.one_to_one(a, b.filter("k = 1").unionByName(spark.createDataFrame([(7, 1.0), (None, 2.0)], "k int, b double")), ["k"])
    assert e.value.found == {"null_keys": 1, "only_left": 1, "only_right": 2}
    assert merge.one_to_one(a, b.filter("k = 1"), ["k"], "left").count() == 2
    with pytest.raises(ValueError):
        merge.one_to_one(a, b, ["k"], "outer")
    assert merge.one_to_one(a.filter("false"), b.filter("false"), ["k"]).count() == 0


def test_one_changed_byte_is_refused(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("k,v\n1,2\n")
    (tmp_path / "in" / "b.csv").write_text("k,v\n3,4\n")
    path = str(tmp_path / "in")
    run = lambda: {"sum": spark.read.csv(path, header=True).agg(F.sum(F.col("v").cast("double")).alias("v"))}
    found = manifest.digest(manifest.manifest(spark, path))
    out = manifest.pinned(spark, [path], run, found)
    assert out["sum"].first() == (6.0, found)
    (tmp_path / "in" / "b.csv").write_text("k,v\n3,5\n")
    with pytest.raises(manifest.ChangedInput):
        manifest.pinned(spark, [path], run, found)
    assert manifest.pinned(spark, [path], run)["sum"].first().v == 7.0

    def changing():
        (tmp_path / "in" / "a.csv").write_text("k,v\n1,9\n")
        return run()

    with pytest.raises(manifest.ChangedInput):
        manifest.pinned(spark, [path], changing)


def test_large_files_are_read_in_pieces(spark, tmp_path):
    """A file larger than one value is read by several tasks; splits don't show, every byte does, and small files keep their SHA-256."""
    r = random.Random(5)
    data = bytearray(r.randbytes(300_000) + b"\r\n\n\n" + bytes(5000) + b"\xef\xbb\xbf")
    (tmp_path / "in").mkdir()
    small, large = tmp_path / "in" / "a small.bin", tmp_path / "in" / "b + large%20.bin"
    small.write_bytes(b"k,v\n1,2\n")
    large.write_bytes(data)

    def found(split=1 << 27):
        old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
        for k in old:
            spark.conf.set(k, str(split))
        out = {x.file: x for x in manifest.manifest(spark, str(tmp_path / "in"), whole=1000, lines=100).collect()}
        for k, v in old.items():
            spark.conf.set(k, v)
        return out

    first = found()
    assert {k: v.length for k, v in first.items()} == {"a small.bin": 8, "b + large%20.bin": len(data)}
    assert first["a small.bin"].sha256 == hashlib.sha256(b"k,v\n1,2\n").hexdigest()
    assert found(10_000) == first == found(77_777)  # some 30 and 4 splits
    seen = {first["b + large%20.bin"].sha256}
    for at in (0, 150_000, 300_001, len(data) - 1):
        other = data.copy()
        other[at] ^= 1
        large.write_bytes(other)
        seen.add(found(50_000)["b + large%20.bin"].sha256)
    ends = [i for i, x in enumerate(data[:300_000]) if x == 10]
    a, b, c = ends[3], ends[4], ends[5]
    large.write_bytes(data[: a + 1] + data[b + 1 : c + 1] + data[a + 1 : b + 1] + data[c + 1 :])  # two lines change places
    seen.add(found(50_000)["b + large%20.bin"].sha256)
    assert len(seen) == 6
    (tmp_path / "in" / "c.csv.gz").write_bytes(gzip.compress(bytes(r.randbytes(5000))))
    assert found()["c.csv.gz"].sha256 == hashlib.sha256((tmp_path / "in" / "c.csv.gz").read_bytes()).hexdigest()


def test_screened_table_follows_its_files(spark, tmp_path):
    source = "/root/testdata/sf0.001"
    for t in ("lineitem", "customer"):
        spark.read.parquet(f"{source}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    orders = spark.read.parquet(f"{source}/orders.parquet")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    before = filings.base(spark, str(tmp_path)).count()
    assert filings.base(spark, str(tmp_path)) is filings.base(spark, str(tmp_path))
    orders.filter("o_orderkey % 2 = 0").write.mode("overwrite").parquet(f"{tmp_path}/orders.parquet")
    assert 0 < filings.base(spark, str(tmp_path)).count() < before


def test_influence_adds_up(spark):
    df = filings.base(spark, "/root/testdata/sf0.001")
    loo = influence.leave_one_filing_out(df)
    one = loo.first()
    rest = df.filter(~F.col("implausible") & (F.col("year_filing_for") == one.year) & (F.col("id") != one.id)).agg(F.sum("recordable_cases"), F.sum("total_hours_worked")).first()
    assert one.rate_without == pytest.approx(200_000 * rest[0] / rest[1])
