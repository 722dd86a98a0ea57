"""The object graph, expectations, lineage, rendering, streaming and the batch pipeline."""

import pytest
from pyspark.sql import functions as F

from ratewright.operators import expectations as ex
from ratewright.operators import graph, render
from ratewright.plans import filings, pipeline

P = graph.Property


@pytest.fixture(scope="module")
def store(spark):
    s = graph.Store(spark, filings.SPEC, clock=lambda: "2020-01-01T00:00:00")
    flags = {f: False for f in filings.screen.FLAGS}
    rows = [(1, 10, 2023, "325", "g", 100.0, 1.0, False), (2, 10, 2024, "325", "g", 200.0, 2.0, False), (3, 11, 2024, "236", None, 5.0, 0.0, True), (4, 99, 2024, "325", "h", 7.0, 1.0, False)]
    df = spark.createDataFrame(rows, "filing_id long, establishment_id long, year long, naics3 string, peer_group string, hours double, cases double, implausible boolean")
    df = df.withColumns({f: F.lit(v) for f, v in flags.items()}).withColumn("flag_hours_missing", F.col("filing_id") == 3)
    s.add("Filing", df)
    s.add("Establishment", spark.createDataFrame([(10, "A", "X"), (11, "B", "Y")], "establishment_id long, company_name string, state string"))
    s.add("ReportingYear", spark.createDataFrame([(2023, 1), (2024, 3)], "year long, n_filings long"))
    s.add("Industry", spark.createDataFrame([("325", "32"), ("236", "23")], "naics3 string, naics2 string"))
    s.add("Sector", spark.createDataFrame([("32", "Manufacturing")], "naics2 string, title string"))
    s.add("PeerGroup", spark.createDataFrame([("g", "325", 2)], "peer_group string, naics3 string, n long"))
    s.add("QualityFlag", spark.createDataFrame([(f,) for f in flags], "flag string"))
    return s


def keys(found):
    return sorted(r[0] for r in found.keys().collect())


def test_sets_and_links(store):
    f = store.objects("Filing")
    assert keys(f.where(year=2024)) == [2, 3, 4] and f.count() == 4
    assert keys(f.where(year=2024).search_around("filed_by")) == [10, 11]
    assert keys(store.objects("Establishment").where(state="X").search_around("filings")) == [1, 2]
    assert keys(store.objects("QualityFlag").where(flag="flag_hours_missing").search_around("raised_by")) == [3]
    assert keys(f.search_around("raises")) == ["flag_hours_missing"]
    assert keys(f.filter(F.col("hours") > 50).where(naics3="325")) == [1, 2]
    assert f.where(filing_id=1).one()["hours"] == 100
    with pytest.raises(KeyError):
        f.where(nothing=1)
    with pytest.raises(KeyError):
        f.search_around("nothing")
    with pytest.raises(LookupError):
        f.one()


def test_integrity(store):
    got = {r.link: (r.resolved, r.null_keys, r.dangling) for r in store.link_integrity().collect()}
    assert got["in_sector"] == (1, 0, 1)
    assert got["filed_by"] == (3, 0, 1) and got["in_group"] == (2, 1, 1) and got["in_year"] == (4, 0, 0)


def test_functions_and_exports(spark, store, tmp_path):
    assert store.call("plausibility_screen", 3) == {"implausible": True, "flags": ["flag_hours_missing"]}
    assert store.call("filing_rate", 1) == 2000.0 and store.call("aggregate_rate") == 200_000 * 4 / 307
    assert sorted(r[0] for r in store.call("peer_filings", 2).keys().collect()) == [2]
    assert store.call("peer_position", 2) == {"n": 1, "below": 0, "equal": 1, "above": 0}
    with pytest.raises(KeyError):
        store.call("nothing")
    with pytest.raises(LookupError):
        store.call("filing_rate", 99)
    assert sorted(r[0] for r in store.objects("Sector").search_around("industries").keys().collect()) == ["325"]
    store.save_json(str(tmp_path))
    assert spark.read.json(f"{tmp_path}/Filing").count() == 4 and spark.read.json(f"{tmp_path}/link_raises").count() == 1
    held = {(r.element, r.name) for r in spark.read.json(f"{tmp_path}/spec").collect()}
    assert {("type", "Sector"), ("link", "in_sector"), ("action", "exclude")} <= held


def test_actions(store):
    for args in (("flag_filing", 1, {}, "me"), ("flag_filing", 77, {"reason": "x"}, "me"), ("flag_filing", 1, {"reason": "x" * 501}, "me"), ("flag_filing", 1, {"reason": "x"}, ""), ("exclude", 1, {"kind": "maybe"}, "me"), ("exclude", 1, {"kind": "other"}, "me"), ("clear_flag", 1, {"reason": "x"}, "me"), ("nothing", 1, {}, "me"), ("flag_filing", 1, {"reason": "x", "more": 1}, "me")):
        with pytest.raises(graph.ActionRejected):
            store.apply(*args)
    assert store.log.count() == 0
    assert store.apply("flag_filing", 1, {"reason": "odd"}, "me") == "act-000001"
    assert store.get("Filing", 1)["analyst_flag"] is True and store.get("Filing", 1)["note"] == "odd"
    with pytest.raises(graph.ActionRejected):
        store.apply("flag_filing", 1, {"reason": "again"}, "me")
    store.apply("clear_flag", 1, {"reason": "fine"}, "you")
    store.apply("exclude", 2, {"kind": "duplicate"}, "me")
    assert store.get("Filing", 1)["analyst_flag"] is False and store.get("Filing", 2)["benchmark_excluded"] is True
    history = store.edit_history("Filing", 1).collect()
    assert [(r.action, r.property, r.before, r.after) for r in history][:2] == [("flag_filing", "analyst_flag", "false", "true"), ("flag_filing", "note", None, "odd")]
    assert sorted(r.filing_id for r in graph.included(store.current("Filing")).collect()) == [1, 4]


def test_rows_must_fit_their_type(spark):
    s = graph.Store(spark, filings.SPEC)
    with pytest.raises(graph.ObjectError):
        s.add("Industry", spark.createDataFrame([("a",), ("a",)], "naics3 string"))
    with pytest.raises(graph.ObjectError):
        s.add("Industry", spark.createDataFrame([(None,)], "naics3 string"))


def test_wrong_specifications():
    o = {"A": graph.ObjectType("A", "k", {"k": P("integer", False), "b": P("what")}), "B": graph.ObjectType("B", "x", {"k": P("string", False)})}
    links = {"l": graph.Link("l", "A", "C", "b"), "m": graph.Link("m", "A", "B", "none")}
    actions = {"a": graph.Action("a", "A", {}, {"b": "$p"}, {"zzz": 1})}
    with pytest.raises(graph.SpecError) as e:
        graph.Spec(o, links, actions).validate(("f",), ())
    assert len(e.value.errors) >= 7


def test_expectations_fail_on_broken_tables(spark):
    E = ex.Expectation
    good = spark.createDataFrame([(1, 2020, 1.0, 2.0, 3.0, "a"), (2, 2021, 2.0, 2.0, 4.0, "b")], "id long, year int, x double, y double, s double, c string")
    rules = [
        E("rows", "t", "rows", {"low": 2, "high": 2}), E("columns", "t", "columns", {"columns": ["id", "x"]}), E("null", "t", "not_null", {"columns": ["x"]}), E("range", "t", "range", {"column": "x", "low": 0, "high": 2}), E("unique", "t", "unique", {"columns": ["id"]}),
        E("years", "t", "years", {"years": [2020, 2021]}), E("set", "t", "value_set", {"column": "c", "values": ["a", "b"]}), E("in", "t", "value_in", {"column": "c", "values": ["a", "b", "z"]}), E("le", "t", "col_le", {"left": "x", "right": "y"}), E("sum", "t", "sum_columns", {"columns": ["x", "y"], "total": "s"}),
        E("ratio", "t", "ratio", {"numerator": "x", "denominator": "y", "column": "x", "scale": 2.0}), E("linear", "t", "linear", {"terms": {"x": 1.0, "y": 1.0}, "column": "s"}), E("row", "t", "monotone_row", {"columns": ["x", "y", "s"]}), E("col", "t", "monotone_col", {"column": "x", "order": "year"}),
        E("group", "t", "group_sum", {"by": ["year"], "column": "y", "value": 2.0}), E("lookup", "t", "lookup", {"columns": ["id"], "other": "u", "other_columns": ["id"]}), E("ref", "t", "sum_ref", {"column": "y", "other": "u", "other_column": "y"}), E("scalar", "t", "scalar", {"expression": "max(x)", "value": 2}),
        E("diff", "t", "scalar_diff", {"expression": "sum(x)", "other": "u", "other_expression": "sum(x)"}), E("where", "t", "rows", {"low": 1, "high": 1}, where={"c": "a"}), E("prefix", "t", "rows", {"low": 1, "high": 1}, where_prefix={"c": "b"}), E("gone", "v", "rows", {}, if_missing="skip"),
    ]
    status = lambda t, strict=False: {r.id: r.status for r in ex.check(spark, {"t": t, "u": good}, rules, strict).collect()}
    assert {k: v for k, v in status(good).items() if v != "pass"} == {"gone": "skip"}
    assert status(good, True)["gone"] == "fail"
    broken = spark.createDataFrame([(1, 2020, 9.0, 1.0, 3.0, "q"), (1, 2025, 3.0, 0.5, 4.0, "q"), (1, 2030, None, 1.0, 4.0, "q"), (5, 2030, 1.0, 1.0, 4.0, "q")], good.schema)
    bad = status(broken)
    assert {k for k, v in bad.items() if v == "pass"} == {"columns"}
    assert status(good.drop("x"))["range"] == "fail"


def test_lineage(spark):
    order = ex.topological(pipeline.LINEAGE, {"filings"})
    assert order.index("peers") < order.index("stability") and len(order) == len(pipeline.LINEAGE)
    assert ex.lineage_table(spark, pipeline.LINEAGE, {"filings"}).count() > 30
    S = ex.Stage
    for stages in ([S("a", ("x",), ("y",)), S("b", ("y",), ("x",))], [S("a", ("q",), ("y",))], [S("a", (), ("y",)), S("b", (), ("y",))]):
        with pytest.raises(ex.LineageError):
            ex.topological(stages, set())


def test_rendering():
    text = render.table([{"a": 1, "b": None}, {"a": 2.5, "b": "x|y"}])
    assert text.splitlines()[1] == "|--:|---|" and "x\\|y" in text and "n/a" in text
    assert render.ticks(0, 10) == [0, 2, 4, 6, 8, 10] and render.percent(0.5) == "50.00 %"
    svg = render.Figure("t<", log_x=True).scatter([1, 10, 0], [1, 2, 3]).line([1, 100], [1, 2]).diagonal().note(1, 1, "here").svg()
    assert svg.startswith("<svg") and svg.count("<circle") == 2 and "t&lt;" in svg
    assert render.Figure("b").bars(["x", "y"], [1, 2]).svg().count("<rect") == 2


def test_stream(spark, tmp_path):
    from ratewright.sources.schema import COLUMNS
    from ratewright.streaming.filings import latest_filings, read_filings, running_rates

    def line(i, est, year, hours):
        v = {"id": i, "establishment_id": est, "naics_code": 3251, "annual_average_employees": 10, "total_hours_worked": hours, "year_filing_for": year, "total_deaths": 0, "total_dafw_cases": 1, "total_djtr_cases": 0, "total_other_cases": 0}
        return ",".join(str(v.get(c, "")) for c in COLUMNS)

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("\n".join([",".join(COLUMNS), line(1, 1, 2024, 20000), line(2, 1, 2024, 10000), line(3, 2, 2023, 9e9)]))
    source = read_filings(spark, str(tmp_path / "in"))
    for name, out in (("rates", running_rates(source)), ("latest", latest_filings(source))):
        q = out.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
    got = {r.year: r for r in spark.table("rates").collect()}
    assert got[2024].n == 2 and got[2024].rate == pytest.approx(200_000 * 2 / 30_000) and got[2023].flagged == 1 and got[2023].rate is None
    assert {(r.establishment_id, r.id) for r in spark.table("latest").collect()} == {(1, 2), (2, 3)}


def test_pipeline(spark, tmp_path):
    from ratewright.operators.derive import deduplicated, derived
    from ratewright.sources.surrogate import filings as view

    rows = deduplicated(derived(view(spark, "/root/testdata/sf0.001")))
    summary = pipeline.run(rows, str(tmp_path), pipeline.Config(least_group=5, permutations=5), ("quality", "metrics", "sectors"))
    assert summary["overall"]["n_filings"] == 796 and (tmp_path / "summary.json").exists() and (tmp_path / "rates.svg").exists()
    assert summary["tables"]["quality_by_year"] >= 5
