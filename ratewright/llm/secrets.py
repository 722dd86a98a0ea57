"""Secret scans over an incremental blob ledger, by DataFrame functions alone.

A blob is a distinct text, addressed by its SHA-256. The ledger is a table in a shared folder: which rule versions each
blob was scanned with, and what they found. A run looks only at pairs of blob and rule version that the ledger lacks,
once per blob however many paths and versions hold it, appends what it saw, and joins all findings of the ledger back to
every path.
"""

from __future__ import annotations

from dataclasses import dataclass
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewright.llm.common import cut, maybe_broadcast, shared_folder, spare
from ratewright.llm.spans import Rule, bound, chunks, gathered, matches, part, placed, written

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


@dataclass(frozen=True)
class Versioned:
    """A rule with the version that the ledger knows it by: a changed rule needs a new one."""

    rule: Rule
    version: int = 1
    base: bool = True

    @property
    def key(self) -> str:
        return f"{self.rule.kind}@{self.version}"


#: Runs of a class are maximal, so a least length inside the pattern drops what a check of the match would drop.
#: A short value after an assignment must be consumed all the same, so that one is checked afterwards.
RULES = (
    Versioned(Rule("assign", ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 12)),
    Versioned(Rule("access", r"AKIA[A-Z0-9]{14,}")),
    Versioned(Rule("hex", r"[0-9a-f]{16,}")),
    Versioned(Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"), base=False),
    Versioned(Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"), base=False),
    Versioned(Rule("forge", r"gh[pousr]_[A-Za-z0-9]{30,}"), base=False),
)


FOUND = "array<struct<rule:string,start:int,end:int>>"


@dataclass(frozen=True)
class Ledger:
    """A table of (blob, scanned: keys of rule versions, found: their spans) in a folder that all executors share.

    Each run appends a folder of its own, which readers see when it is complete. A run that was lost is repeated; a pair
    that two runs have scanned counts once.
    """

    folder: str

    @staticmethod
    def fresh(spark: SparkSession) -> Ledger:
        return Ledger(f"{shared_folder(spark)}/ratewright/ledger-{uuid4().hex}")

    def rows(self, spark: SparkSession) -> DataFrame:
        schema = f"blob string, scanned array<string>, found {FOUND}"
        try:
            return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(self.folder)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], schema)

    def append(self, rows: DataFrame) -> DataFrame:
        """`rows`, written as one run and read again."""
        at = f"{self.folder}/{uuid4().hex}"
        rows.write.parquet(at)
        return rows.sparkSession.read.schema(rows.schema).parquet(at)


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def scanned(blobs: DataFrame, rules: tuple[Versioned, ...] = RULES) -> DataFrame:
    """Rows of the ledger from blob, text and done (keys of the ledger, null: none), for the rule versions not done."""
    text, keys = F.coalesce(F.col("text"), F.lit("")), F.array(*(F.lit(r.key) for r in rules))
    wanted = lambda r, found: F.when(F.coalesce(~F.array_contains("done", r.key), F.lit(True)), found)
    first = blobs.select("blob", "done", text.alias("text"), *(wanted(r, matches(text, r.rule)).alias(f"m_{r.rule.kind}") for r in rules))
    spans = [F.transform(placed(F.col("text"), F.coalesce(f"m_{r.rule.kind}", F.array().cast("array<string>")), r.rule), named(r.key)) for r in rules]
    left = F.when(F.col("done").isNull(), keys).otherwise(F.array_except(keys, "done"))
    return first.select("blob", left.alias("scanned"), F.concat(*spans).cast(FOUND).alias("found"))


def named(key: str):  # noqa: ANN201
    return lambda x: F.struct(F.lit(key).alias("rule"), x["start"].alias("start"), x["end"].alias("end"))


def scan(texts: DataFrame, ledger: Ledger, rules: tuple[Versioned, ...] = RULES) -> DataFrame:
    """Scans the pairs of distinct text and rule version that the ledger lacks; gives the rows appended to it.

    Copies meet map-side first, so a text that a third of all rows hold moves once for each map task.
    """
    spark = texts.sparkSession
    blobs = texts.select(blob_of(F.col("text")).alias("blob"), "text").dropDuplicates(["blob"])
    before, keys = ledger.rows(spark), F.array(*(F.lit(r.key) for r in rules))
    if before.isEmpty():
        return ledger.append(scanned(blobs.withColumn("done", F.lit(None).cast("array<string>")), rules))
    known = before.groupBy("blob").agg(F.flatten(F.collect_list("scanned")).alias("done"))
    blobs = blobs.join(known, "blob", "left").filter(F.col("done").isNull() | (F.size(F.array_except(keys, "done")) > 0))
    return ledger.append(scanned(blobs, rules))


def findings(ledger: Ledger, spark: SparkSession, rules: tuple[Versioned, ...] = RULES) -> DataFrame:
    """(blob, marks: array of start, rank, end, kind) of the blobs in which these rule versions have found something."""
    own = lambda r: F.when(F.array_contains("scanned", r.key), F.filter("found", lambda x: x["rule"] == r.key))
    marks = lambda i, r: F.transform(F.coalesce(r.key, F.array().cast(FOUND)), lambda x: F.struct(x["start"].alias("start"), F.lit(i).alias("rank"), x["end"].alias("end"), F.lit(r.rule.kind).alias("kind")))
    # of runs that have scanned a blob with the same rule version any one counts, as they found the same
    some = ledger.rows(spark).filter(F.size("found") > 0).groupBy("blob").agg(*(F.any_value(own(r), True).alias(r.key) for r in rules))
    return some.select("blob", F.concat(*(marks(i, r) for i, r in enumerate(rules))).alias("marks")).filter(F.size("marks") > 0)


def find_secrets(docs: DataFrame, rules: tuple[Versioned, ...] = RULES, ledger: Ledger | None = None, keep: tuple[str, ...] = ("doc_id",), pairs: bool = False) -> DataFrame:
    """The `keep` columns, n_assign, n_access, n_hex, base_sha256, spans, blob, n_added: a row for each row of `docs`.

    `ledger`: what was scanned before, and is added to (a new one, if none is given). With `pairs`, also with how many
    rule versions this run scanned the text. Null and empty texts are one blob without findings. Repeated rows and
    copies share their blob's findings. Matches of one kind don't overlap, those of two kinds may; equal starts are
    ordered by kind as listed. An empty table gives no rows; further columns are ignored. Spans are code points, end
    exclusive. Rows of a blob that very many hold meet findings by broadcast, or else by a join that Spark splits by skew.
    """
    ledger = ledger or Ledger.fresh(docs.sparkSession)
    new = scan(docs, ledger, rules)
    base = [r.rule.kind for r in rules if r.base]
    of = lambda kinds: F.filter("marks", lambda x: x["kind"].isin(*kinds))
    made = findings(ledger, docs.sparkSession, rules).select("blob", *(F.size(of([k])).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")), written(of(base)).alias("base"), written(F.col("marks")).alias("spans"), (F.size("marks") - F.size(of(base))).cast("long").alias("n_added"))
    made = cut(made, "secrets-found")  # blobs with findings only: as a rule few enough to go to every task
    out = docs.select(*keep, blob_of(F.col("text")).alias("blob")).join(maybe_broadcast(made), "blob", "left")
    zero = F.lit(0).cast("long")
    columns = [*keep, *(F.coalesce(f"n_{k}", zero).alias(f"n_{k}") for k in ("assign", "access", "hex")), F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), "blob", F.coalesce("n_added", zero).alias("n_added")]
    if not pairs:
        return out.select(*columns)
    return out.join(new.select("blob", F.size("scanned").cast("long").alias("new_pairs")), "blob", "left").select(*columns, F.coalesce("new_pairs", zero).alias("pairs"))


def without_secrets(docs: DataFrame, rules: tuple[Versioned, ...] = RULES, mark: str = "[secret]", ledger: Ledger | None = None) -> DataFrame:
    """`docs` with every found span replaced by `mark`, all columns as they were; documents without secrets stay as they are.

    The text is rebuilt from the spans of all rules, joined where they overlap. n_chars, if there, follows the text.
    Null and empty texts stay; repeated rows are all kept, and changed alike; an empty table gives no rows.
    """
    ledger = ledger or Ledger.fresh(docs.sparkSession)
    scan(docs, ledger, rules)
    blob, spans, changed = (spare(docs, c) for c in ("__blob", "__cut", "__text"))
    every = F.array_sort(F.transform("marks", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))))
    found = cut(findings(ledger, docs.sparkSession, rules).select(F.col("blob").alias(blob), every.alias(spans)), "secrets")

    def rebuilt(of: Column) -> Column:
        def step(at: Column, i: Column) -> tuple[Column, Column, Column]:
            x = F.get(of["spans"], i)
            return F.greatest(at, x["end"]), x["start"] >= at, F.concat(part(of["chunks"], at, x["start"]), F.lit(mark))

        last = F.array_max(F.transform(of["spans"], lambda x: x["end"]))
        return F.concat(F.array_join(gathered(F.size(of["spans"]), F.lit(0), step, "array<string>"), ""), part(of["chunks"], last, F.length("text")))

    text = F.when(F.col(spans).isNull(), F.col("text")).otherwise(bound(F.struct(F.col(spans).alias("spans"), chunks(F.col("text")).alias("chunks")), rebuilt))
    out = docs.withColumn(blob, blob_of(F.col("text"))).join(maybe_broadcast(found), blob, "left").withColumn(changed, text)
    named = {c: F.col(changed) if c == "text" else F.when(F.col(spans).isNull(), F.col(c)).otherwise(F.length(changed)).cast(docs.schema[c].dataType) if c == "n_chars" else F.col(c) for c in docs.columns}
    return out.select(*(v.alias(k) for k, v in named.items()))


def document_versions(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the first state of a store of texts, all its versions), each with path, version, doc_id and text.

    Every document is a path of its own; every fifth id is at a second path too, with the same text. In version 2 each
    third id has an assignment more at its end.
    """
    rows = docs.select("doc_id", "text", F.concat(F.lit("main/"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("path"))
    copies = rows.filter(F.col("doc_id") % 5 == 0).withColumn("path", F.concat(F.lit("mirror/"), F.col("doc_id").cast("string")))
    first = rows.unionByName(copies).withColumn("version", F.lit(1))
    ending = F.concat(F.lit("\ntoken = "), F.substring(F.md5(F.col("doc_id").cast("string")), 1, 14))
    changed = rows.filter(F.col("doc_id") % 3 == 0).withColumn("text", F.concat(F.coalesce("text", F.lit("")), ending)).withColumn("version", F.lit(2))
    return first, first.unionByName(changed)


def rescan(docs: DataFrame) -> DataFrame:
    """A second run over a store whose first state was scanned: all versions of all paths, with one rule raised.

    The raised rule (assignments of 16 characters or more) is scanned in every text, the others in new texts only.
    """
    first, every = document_versions(docs)
    ledger = Ledger.fresh(docs.sparkSession)
    scan(first, ledger)
    raised = Versioned(Rule("assign", ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 16), version=2)
    return find_secrets(every, (raised, *RULES[1:]), ledger, keep=("path", "version", "doc_id"), pairs=True).drop("base_sha256")
