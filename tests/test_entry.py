"""The driver's contract, and that the rest works without the language-model folder."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_smoke(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.oracle_sql()) >= 45


@pytest.mark.parametrize("name", ["screen_by_year", "sensitivity_grid", "peer_percentiles_by_year", "panel_transitions", "trend_reversals", "wilson_by_sector", "precision_cases", "power_ladder", "detectability_by_band", "gini_bootstrap"])
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE TABLE {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    found = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    want = sorted(map(str, found.fetchall()))
    got = sorted(str(tuple(r[c] for c in columns)) for r in entry.queries()[name](spark, DATA).collect())
    assert got == want


def test_imports_without_optional_parts(tmp_path):
    for name in ("__spark_entry__.py", "bench.py"):
        (tmp_path / name).write_text((ROOT / name).read_text())
    import shutil

    shutil.copytree(ROOT / "ratewright", tmp_path / "ratewright", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert not [k for k in q if k.startswith('op') or k == 'pipeline']; assert 'screen_by_year' in q and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
