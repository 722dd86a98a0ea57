"""Files with drifting headers and encodings, strict uploads, catalogue, series and result tables."""

import io
import json
import sqlite3
import zipfile

import pytest

from ratewright.sources import catalog, naics, results, series
from ratewright.sources.loader import UploadError, encoding_of, load_filings, load_fixture, read_strict
from ratewright.sources.schema import SchemaError

HEADER = "id,establishment_id,naics_code,annual_average_employees,total_hours_worked,no_injuries_illnesses,total_deaths,total_dafw_cases,total_djtr_cases,total_other_cases,year_filing_for,company_name"


def put(folder, name, text, encoding="utf-8"):
    path = folder / name
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_minimal_file(spark, tmp_path):
    path = put(tmp_path, "a.csv", f"{HEADER}\n1,10,3251,50,100000,1,0,1,0,1,2024,ACME\n")
    row = load_fixture(spark, path, str(tmp_path / "s")).first()
    assert (row.recordable_cases, row.company_name, row.id, row.year_filing_for) == (2, "ACME", 1, 2024)


def test_encodings_order_and_extra_columns(spark, tmp_path):
    old = put(tmp_path, "old.csv", f"{HEADER}\n1,10,3251,50,100000,1,0,1,0,1,2023,Joe’s\n", "cp1252")
    names = HEADER.split(",")
    values = dict(zip(names, "2,11,3252,60,1_000,1,0,1,12d,1,2024,Café".split(","), strict=True))
    new = put(tmp_path, "new.csv", " , ".join(f" {n.upper()} " for n in reversed(names)) + ",street_address\n" + ",".join(values[n] for n in reversed(names)) + ",x\n")
    df, report = load_filings(spark, [old, new], str(tmp_path / "s"))
    rows = {r.id: r for r in df.collect()}
    assert rows[1].company_name == "Joe’s" and rows[2].company_name == "Café"
    assert rows[2].total_hours_worked is None and rows[2].total_djtr_cases is None and rows[2].annual_average_employees == 60
    assert report.encoding_by_file == {"old.csv": "cp1252", "new.csv": "utf-8"} and report.extra_columns_by_file["new.csv"] == ["street_address"]
    assert "street_address" not in df.columns and report.to_json()["rows_raw"] == 2
    bad = put(tmp_path, "bad.csv", "")
    (tmp_path / "bad.csv").write_bytes(b"\x81\xff")
    assert encoding_of(bad) == "utf-8-replace"


def test_amendments_and_years(spark, tmp_path):
    lines = [f"{i},{e},3251,50,{h},1,0,1,0,1,{y},A" for i, e, h, y in ((1, 100, 1000, 2024), (7, 100, 2000, 2024), (3, 200, 3000, 2024), (9, 100, 5, 2023))]
    path = put(tmp_path, "a.csv", "\n".join([HEADER, *lines]))
    df, report = load_filings(spark, [path], str(tmp_path / "s"), years=[2024])
    assert {r.establishment_id: r.total_hours_worked for r in df.collect()} == {100: 2000, 200: 3000}
    assert (report.rows_raw, report.rows_after_dedup, report.rows_dropped) == (4, 2, 2)


def test_archives(spark, tmp_path):
    for k in (1, 2):
        with zipfile.ZipFile(tmp_path / f"{k}.zip", "w") as z:
            for i in range(k):
                z.writestr(f"f{i}.csv", f"{HEADER}\n1,10,3251,50,100000,1,0,1,0,1,2024,ACME\n")
    assert load_fixture(spark, str(tmp_path / "1.zip"), str(tmp_path / "s")).count() == 1
    with pytest.raises(SchemaError):
        load_fixture(spark, str(tmp_path / "2.zip"), str(tmp_path / "s"))
    with pytest.raises(SchemaError):
        load_fixture(spark, put(tmp_path, "m.csv", "id,naics_code\n1,2\n"), str(tmp_path / "s"))


@pytest.mark.parametrize(("text", "code"), [
    ("year,employees,hours,cases\n2023,10,20000,1\n2024,10,20000,2\n", None), ("year,employees,hours\n2023,1,2\n", "missing_columns"), ("year,employees,hours,cases\n2023,10,abc,1\n", "bad_cell"), ("year,employees,hours,cases\n2023,10,20,1.5\n", "bad_cell"),
    ("year,employees,hours,cases\n2023,10,20,9007199254740993\n", "bad_cell"), ("year,employees,hours,cases,filing_id\n2023,1,2,3,a\n2023,1,2,3,a\n", "repeated_id"), ("year,year,hours,cases\n1,2,3,4\n", "repeated_column"), ("year,employees,hours,cases\n", "empty"), ("﻿year,employees,hours,cases,filing_id\n2023,1,2,3,\"a,\"\"b\n\"\n", None),
])
def test_strict_uploads(spark, tmp_path, text, code):
    path = put(tmp_path, "u.csv", text)
    if code is None:
        assert read_strict(spark, path).count() >= 1
    else:
        with pytest.raises(UploadError) as e:
            read_strict(spark, path)
        assert e.value.code == code


def test_catalogue_and_download(tmp_path):
    assert len(catalog.all_files()) == 9 and len(catalog.all_files(True)) == 10
    assert catalog.by_key("ita_300a_2018").expected_bytes == 16970794
    with pytest.raises(KeyError):
        catalog.by_key("x")
    f = catalog.DatasetFile("k", 2020, "f.zip", "f.zip", 3, "0" * 64)
    get = lambda url, timeout: io.BytesIO(b"abc")
    record = catalog.fetch(f, str(tmp_path), get)
    assert not record["hash_matches"] and (tmp_path / "f.zip").read_bytes() == b"abc"
    with pytest.raises(catalog.DownloadError):
        catalog.fetch(catalog.DatasetFile("k", 2020, "g.zip", "g.zip", 5), str(tmp_path), get)
    assert not (tmp_path / "g.zip.part").exists()
    with pytest.raises(FileNotFoundError):
        catalog.require(str(tmp_path))


def test_series(spark, tmp_path):
    good = {"status": "REQUEST_SUCCEEDED", "message": [], "Results": {"series": [{"seriesID": "S1", "data": [{"year": "2020", "period": "A01", "value": "2.5", "footnotes": [{}]}, {"year": "2021", "period": "A01", "value": "-", "footnotes": [{"code": "P"}]}]}]}}
    sent = []

    def send(r):
        sent.append(json.loads(r.data))
        return io.BytesIO(json.dumps(good).encode())

    at = series.keep(["S1"], range(2020, 2022), str(tmp_path), send)
    assert series.keep(["S1"], range(2020, 2022), str(tmp_path), send) == at and sent == [{"seriesid": ["S1"], "startyear": "2020", "endyear": "2021"}]
    assert [tuple(r) for r in series.to_frame(spark, at).orderBy("year").collect()] == [("S1", 2020, "A01", 2.5, False), ("S1", 2021, "A01", None, True)]
    with pytest.raises(series.NoObservations):
        series.keep(["S1", "S2"], range(2020, 2022), str(tmp_path), send)
    assert len(list(tmp_path.iterdir())) == 1


def test_titles(spark):
    assert naics.title("325.0") == "Chemical Manufacturing" and naics.title(999) is None and naics.title(None) is None
    assert naics.title_table(spark).count() == len(naics.titles()) > 90
    df = spark.createDataFrame([("325",), ("1",)], "c string")
    assert [r[0] for r in df.select(naics.title_column(df["c"])).collect()] == ["Chemical Manufacturing", None]


def test_result_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a"b', 2.5, True), (2, None, float("nan"), False)], "i long, s string, d double, b boolean")
    results.write_csv(df, str(tmp_path / "t"))
    back = results.read_csv(spark, str(tmp_path / "t"), "i long, s string, d double, b boolean")
    assert back.filter("i = 1").first()["s"] == 'a"b'
    results.write_json({"x": float("inf"), "y": [1, {"z": float("nan")}]}, str(tmp_path / "j.json"))
    assert json.loads((tmp_path / "j.json").read_text()) == {"x": None, "y": [1, {"z": None}]}
    results.write_sqlite({"t": df}, str(tmp_path / "x.db"))
    with sqlite3.connect(tmp_path / "x.db") as db:
        assert db.execute("SELECT i, s, d, b FROM t ORDER BY i").fetchall() == [(1, 'a"b', 2.5, 1), (2, None, None, 0)]
    db.close()
    assert results.safe_cell("=1+1") == "'=1+1" and results.safe_cell(-1) == "-1" and results.safe_cell('a,"b') == '"a,""b"'
    cells = spark.createDataFrame([("=x",), ("a,b",), (None,)], "c string")
    assert [r[0] for r in cells.select(results.safe_column("c")).collect()] == ["'=x", '"a,b"', ""]
    with pytest.raises(ValueError):
        results.rows_of(spark.range(10), 5)
