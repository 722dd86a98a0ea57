"""A corpus from raw documents: language, near duplicates, benchmark passages, secrets, source mix.

Each stage reads what its predecessor wrote, decides about all of it, and hands on the columns of documents; the
last adds how often the mix takes a document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewright.llm import contamination, jaccard, languages, mixing, secrets
from ratewright.llm.common import crc_mod, cut
from ratewright.shipping import shipped


@shipped
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that one of the learned languages explains; null texts and texts without letters go.

    Of equally likely languages the first by name counts; repeated rows are judged alike and all stay. Nothing is learned from
    an empty table, and it stays empty.
    """
    columns = docs.columns
    who = languages.fit(docs, crc_mod(F.col("doc_id"), 4) != 2)
    return languages.identify(docs, who, tuple(columns)).filter(~F.col("__rejected")).select(*columns)


@shipped
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, of the least id, of each group of similar documents.

    Of repeated rows one stays; rows without an id come after those with one. Texts without words are alone and all stay. An
    empty table stays empty.
    """
    return jaccard.one_of_each(docs)


@shipped
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with less than a twentieth of their words in benchmark windows.

    Null and empty texts and all documents under an empty benchmark are clean; repeated rows are judged alike.
    """
    return contamination.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@shipped
def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark; n_chars follows. Null and empty texts stay as they are, repeated rows all
    stay and are changed alike."""
    return secrets.without_secrets(docs)


@shipped
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes at least once, with mix_size, mix_target, mix_copies and mix_taken (words).

    A null source is a source, last in order; documents without words aren't taken; repeated rows are taken equally often.
    """
    return mixing.mixed_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
]

#: The trained and random stages (languages, mix) have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *before, (_, last) = STAGES
    for name, stage in before:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return last(spark, docs, sf_dir)
