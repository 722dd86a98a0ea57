"""Filing files: CSV or ZIP with one CSV, in one of several encodings, pooled by name into one frame."""

from __future__ import annotations

import codecs
import csv
import os
import zipfile
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewright.operators.derive import deduplicated, derived
from ratewright.functions import decimals
from ratewright.sources.schema import SchemaError, to_canonical


@dataclass
class LoadReport:
    """What a load read, file by file, and what deduplication dropped."""

    rows_by_file: dict[str, int] = field(default_factory=dict)
    encoding_by_file: dict[str, str] = field(default_factory=dict)
    extra_columns_by_file: dict[str, list[str]] = field(default_factory=dict)
    rows_raw: int = 0
    rows_after_dedup: int = 0

    @property
    def rows_dropped(self) -> int:
        return self.rows_raw - self.rows_after_dedup

    def to_json(self) -> dict:
        return asdict(self) | {"rows_dropped": self.rows_dropped}


def encoding_of(path: str, block: int = 1 << 20) -> str:
    """UTF-8 if the whole file is, else windows-1252 if that has all its bytes, else UTF-8 with marks for what it isn't.

    The file is read in blocks: Spark itself doesn't say when bytes aren't the encoding that it was told.
    """
    for name in ("utf-8", "cp1252"):
        decoder = codecs.getincrementaldecoder(name)()
        try:
            with open(path, "rb") as f:
                while chunk := f.read(block):
                    decoder.decode(chunk)
                decoder.decode(b"", True)
            return name
        except UnicodeDecodeError:
            continue
    return "utf-8-replace"


def transcoded(path: str, encoding: str, staging: str) -> str:
    """The path of a UTF-8 copy in `staging`, or `path` itself if it is that already."""
    if encoding == "utf-8":
        return path
    os.makedirs(staging, exist_ok=True)
    target = os.path.join(staging, os.path.basename(path) + ".utf8.csv")
    name, errors = ("cp1252", "strict") if encoding == "cp1252" else ("utf-8", "replace")
    with open(path, encoding=name, errors=errors, newline="") as src, open(target, "w", encoding="utf-8", newline="") as out:
        while chunk := src.read(1 << 20):
            out.write(chunk)
    return target


def unzipped(path: str, staging: str) -> str:
    """The one CSV of a ZIP file, unpacked into `staging`."""
    with zipfile.ZipFile(path) as z:
        names = [n for n in z.namelist() if n.lower().endswith(".csv") and not n.startswith("__MACOSX/")]
        if len(names) != 1:
            raise SchemaError(f"{os.path.basename(path)} must hold exactly one CSV file, not {len(names)}")
        os.makedirs(staging, exist_ok=True)
        target = os.path.join(staging, os.path.basename(path) + ".csv")
        with z.open(names[0]) as src, open(target, "wb") as out:
            while chunk := src.read(1 << 20):
                out.write(chunk)
    return target


def read_file(spark: SparkSession, path: str, staging: str) -> tuple[DataFrame, str, list[str]]:
    """(canonical frame, encoding, extra columns) of one file. All cells are text first; each file has its own header."""
    plain = unzipped(path, staging) if path.lower().endswith(".zip") else path
    encoding = encoding_of(plain)
    raw = spark.read.csv(transcoded(plain, encoding, staging), header=True, inferSchema=False, multiLine=True, quote='"', escape='"', enforceSchema=False)
    frame, extra = to_canonical(raw)
    return frame, encoding, extra


def load_filings(spark: SparkSession, paths: list[str], staging: str, years: list[int] | None = None, dedup: bool = True) -> tuple[DataFrame, LoadReport]:
    """Filings of all files, by name; years are picked before amendments are dropped. The report counts rows of each file."""
    if not paths:
        raise ValueError("no files to load")
    report, frames = LoadReport(), []
    for i, path in enumerate(paths):
        frame, encoding, extra = read_file(spark, path, staging)
        name = os.path.basename(path)
        report.encoding_by_file[name], report.extra_columns_by_file[name] = encoding, extra
        frames.append(frame.withColumns({"_file": F.lit(name), "_seq": F.lit(i).cast("long") * (1 << 40) + F.monotonically_increasing_id()}))
    pooled = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    report.rows_by_file = {r["_file"]: r["count"] for r in pooled.groupBy("_file").count().collect()}
    report.rows_raw = sum(report.rows_by_file.values())
    if years is not None:
        pooled = pooled.filter(F.col("year_filing_for").isin(*years))
    kept = deduplicated(pooled, "_seq") if dedup else pooled
    out = derived(kept.drop("_seq", "_file"))
    report.rows_after_dedup = out.count()
    return out, report


def load_fixture(spark: SparkSession, path: str, staging: str) -> DataFrame:
    """One CSV by the same way, amendments dropped."""
    return load_filings(spark, [path], staging)[0]


STRICT_LIMITS = {"bytes": 10 * 1024 * 1024, "rows": 50_000, "columns": 128}


class UploadError(ValueError):
    """A reason to refuse an uploaded table as a whole, with its code and row."""

    def __init__(self, code: str, message: str, row: int | None = None):
        super().__init__(message if row is None else f"{message} (row {row})")
        self.code, self.row = code, row


def read_strict(spark: SparkSession, path: str, required: tuple[str, ...] = ("year", "employees", "hours", "cases")) -> DataFrame:
    """A small two-year table, refused as a whole if any cell is off: sizes, header, numbers, exact whole numbers, ids."""
    size = sum(f.getLen() for f in spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(spark._jvm.org.apache.hadoop.fs.Path(path)))
    if size > STRICT_LIMITS["bytes"]:
        raise UploadError("too_large", "the file has more than 10 MB")
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', mode="FAILFAST")
    header = spark.read.text(path).first()  # Spark itself gives repeated names numbers
    normalised_or_refused(next(csv.reader([header[0]]), []) if header else [])
    raw = raw.toDF(*normalised_or_refused(raw.columns))
    if len(raw.columns) > STRICT_LIMITS["columns"]:
        raise UploadError("too_many_columns", "more than 128 columns")
    if missing := [c for c in required if c not in raw.columns]:
        raise UploadError("missing_columns", f"missing columns: {missing}")
    rows = raw.limit(STRICT_LIMITS["rows"] + 1).withColumn("_row", F.monotonically_increasing_id() + 2)
    rows = rows.cache()
    if (n := rows.count()) > STRICT_LIMITS["rows"]:
        raise UploadError("too_many_rows", "more than 50,000 rows")
    if not n:
        raise UploadError("empty", "no rows")
    bad = F.lit(None).cast("string")
    for c in ("year", "employees", "hours", "cases"):
        text = F.col(c)
        tests = {"is not a number": ~decimals.is_number(text) | F.coalesce(F.trim(text).startswith("-"), F.lit(False)), "is too large": decimals.is_unsafe(text)}
        if c in ("year", "cases"):
            tests["is not a whole number"] = ~decimals.is_whole(text)
        bad = F.coalesce(bad, *(F.when(test, F.lit(f"{c} {what}")) for what, test in tests.items()))
    if first := rows.withColumn("_bad", bad).filter("_bad is not null").orderBy("_row").select("_row", "_bad").first():
        raise UploadError("bad_cell", first[1], first[0])
    if "filing_id" in raw.columns:
        if long := rows.filter(F.length("filing_id") > 512).select("_row").first():
            raise UploadError("long_id", "a filing id has more than 512 characters", long[0])
        if twice := rows.filter("filing_id is not null").groupBy("year", "filing_id").count().filter("count > 1").first():
            raise UploadError("repeated_id", f"filing id {twice[1]} occurs twice in {twice[0]}")
    return rows.select(F.trim("year").cast("double").cast("int").alias("year"), F.trim("employees").cast("double").alias("employees"), F.trim("hours").cast("double").alias("hours"), F.trim("cases").cast("double").alias("cases"), (F.col("filing_id") if "filing_id" in raw.columns else F.col("_row").cast("string")).alias("filing_id"))


def normalised_or_refused(names: list[str]) -> list[str]:
    from ratewright.sources.schema import normalised

    try:
        return normalised(names)
    except SchemaError as e:
        raise UploadError("repeated_column", str(e)) from None
