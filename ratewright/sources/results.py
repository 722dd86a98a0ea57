"""Result tables: written as CSV, JSON, SQLite or tables, and read again with the types they had."""

from __future__ import annotations

import json
import math
import os
import sqlite3

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, one_file: bool = True) -> None:
    """CSV with a header. One file is for results of bounded size; give one_file=False for others."""
    flat = df.select(*(F.to_json(c).alias(c) if t.startswith(("map", "array", "struct")) else F.col(c) for c, t in df.dtypes))
    (flat.coalesce(1) if one_file else flat).write.mode("overwrite").csv(path, header=True, escape='"', nullValue="")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, escape='"', enforceSchema=False)


def plain(value: object) -> object:
    """A value as strict JSON has it: NaN and infinities are null, numbers plain."""
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if hasattr(value, "item"):
        value = value.item()
    return None if isinstance(value, float) and not math.isfinite(value) else value


def write_json(document: dict, path: str) -> None:
    with open(path, "w", encoding="utf-8") as out:
        json.dump(plain(document), out, indent=1, sort_keys=True, allow_nan=False)


def rows_of(df: DataFrame, most: int = 100_000) -> list[dict]:
    """A small result on the driver; larger ones are refused, not cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: not a result for the driver")
    return [r.asDict(recursive=True) for r in rows]


def write_sqlite(tables: dict[str, DataFrame], path: str) -> None:
    """Small tables in one SQLite file, replaced as a whole."""
    part = path + ".part"
    if os.path.exists(part):
        os.remove(part)
    kinds = {"string": "TEXT", "double": "REAL", "float": "REAL", "boolean": "INTEGER"}
    with sqlite3.connect(part) as db:
        for name, df in tables.items():
            columns = [(c, kinds.get(t, "INTEGER" if t.endswith("int") else "TEXT")) for c, t in df.dtypes]
            db.execute(f'CREATE TABLE "{name}" ({", ".join(f"{q(c)} {t}" for c, t in columns)})')
            rows = [[json.dumps(plain(v)) if isinstance(v, (dict, list)) else plain(v) for v in r.values()] for r in rows_of(df)]
            db.executemany(f'INSERT INTO "{name}" VALUES ({", ".join("?" * len(columns))})', rows)
    db.close()
    os.replace(part, path)


def q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def safe_cell(value: object) -> str:
    """A CSV cell that spreadsheets don't take for a formula, quoted where it must be."""
    text = "" if value is None else str(value)
    if text[:1] in ("=", "+", "-", "@", "\t", "\r") and not isinstance(value, (int, float)):
        text = "'" + text
    return '"' + text.replace('"', '""') + '"' if any(c in text for c in ',"\n\r') else text


def safe_column(column: str):  # noqa: ANN201
    """The same as an expression."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    guarded = F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)
    return F.when(guarded.rlike(r'[,"\n\r]'), F.concat(F.lit('"'), F.replace(guarded, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(guarded)
