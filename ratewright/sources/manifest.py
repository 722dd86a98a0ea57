"""What a result was made of: listings and digests of input files, and results that are bound to them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ratewright.shared import cut

#: Bytes of a file that one task may hold; lines of a piece of a larger one.
WHOLE, LINES = 32 << 20, 4096

#: Ends of names that Spark's reader of lines takes as compressed.
PACKED = ("gz", "bz2", "deflate", "snappy", "lz4", "zst", "xz")


def listing(spark: SparkSession, *paths: str) -> tuple[str, ...]:
    """path, length and time of change of every file below some paths, in order. The files themselves aren't read."""
    rows = spark.read.format("binaryFile").load([*paths]).select("path", "length", "modificationTime")
    return tuple(sorted(f"{r.path} {r.length} {r.modificationTime.timestamp()}" for r in rows.collect()))


def manifest(spark: SparkSession, *paths: str, whole: int = WHOLE, lines: int = LINES) -> DataFrame:
    """file (its last name), length and sha256 of every file below some paths; digests are taken where the files are read.

    A file of up to `whole` bytes is one value while its SHA-256 is taken. A larger one is read in Spark's splits, and its sha256 is that of
    the digests of its pieces of `lines` lines (as split at line feeds, whatever the file holds), themselves of the lines' digests: it binds
    every byte, but isn't the file's own SHA-256. Compressed files that Spark's reader of lines would unpack are
    always one value, up to 2 GB. Folders without files give no rows.
    """
    paths = tuple(dict.fromkeys(paths))
    binary = spark.read.format("binaryFile")
    name, sha = F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256")
    small = binary.load([*paths]).filter(F.col("length") <= whole).select(name, "length", sha)
    if binary.load([*paths]).filter(F.col("length") > whole).select("length").isEmpty():
        return small
    packed = binary.option("pathGlobFilter", f"*.{{{','.join(PACKED)}}}").load([*paths]).filter(F.col("length") > whole).select(name, "length", sha)
    return small.unionByName(packed).unionByName(in_pieces(spark, paths, whole, lines))


def in_pieces(spark: SparkSession, paths: tuple[str, ...], whole: int, lines: int) -> DataFrame:
    """file, length and sha256 of the files of more than `whole` bytes; no task reads more than a split, whose bounds don't show in the result."""
    at = F.col("_metadata")
    read = spark.read.option("lineSep", "\n").text([*paths])
    large = read.filter((at["file_size"] > whole) & ~at["file_name"].rlike(rf"\.({'|'.join(PACKED)})$"))
    found = cut(large.select(at["file_path"].alias("path"), at["file_name"].alias("file"), at["file_size"].alias("length"), at["file_block_start"].alias("start"), F.monotonically_increasing_id().alias("id"), F.unhex(F.sha2(F.col("value").cast("binary"), 256)).alias("sha")), "lines")
    # a line's place in its file: its place in the split (whose lines have numbers in a row), moved on by the lines of the splits before
    splits = found.groupBy("path", "start").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.col("id") + F.col("shift")
    placed = found.join(F.broadcast(splits.select("path", "start", (before - F.col("first")).alias("shift"))), ["path", "start"]).withColumn("place", place).withColumn("piece", F.floor(F.col("place") / lines))
    joined = lambda by: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, "sha"))), lambda x: F.hex(x["sha"])), ""), 256)
    pieces = placed.groupBy("path", "piece").agg(F.unhex(joined("place")).alias("sha"), F.first("file").alias("file"), F.first("length").alias("length"))
    name = F.url_decode(F.replace(F.col("file"), F.lit("+"), F.lit("%2B"))).alias("file")  # Spark gives it as part of a URI, where + is itself
    return pieces.groupBy("path").agg(F.first("file").alias("file"), F.first("length").alias("length"), joined("piece").alias("sha256")).select(name, "length", "sha256")


def digest(files: DataFrame) -> str:
    """One SHA-256 for a manifest, whatever the order of its rows."""
    lines = F.array_sort(F.collect_list(F.concat_ws(" ", "file", F.col("length").cast("string"), "sha256")))
    return files.agg(F.sha2(F.array_join(lines, "\n"), 256).alias("d")).first().d


class ChangedInput(ValueError):
    """Inputs aren't those that a result is bound to."""


def pinned(spark: SparkSession, paths: list[str], run: Callable[[], dict[str, DataFrame]], expected: str | None = None) -> dict[str, DataFrame]:
    """The tables of `run`, each with a column input_sha256: the digest of all files below `paths`.

    With `expected`, inputs of another digest are refused before anything runs. The digest is taken again when the tables are planned: if a file
    has changed meanwhile, there is no result.
    """
    found = digest(manifest(spark, *paths))
    if expected is not None and found != expected:
        raise ChangedInput(f"inputs have digest {found}, not {expected}")
    out = {k: df.withColumn("input_sha256", F.lit(found)) for k, df in run().items()}
    if digest(manifest(spark, *paths)) != found:
        raise ChangedInput("inputs changed during the run")
    return out
