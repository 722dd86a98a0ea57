"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewright.llm import bpe, contamination, jaccard, languages, mixing, oracle, personal, phrases, ppm, quality, ranking, revisits, secrets, tokens
from ratewright.llm.common import crc_mod


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate_quality(table(spark, sf_dir, "documents"))


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return ppm.score_texts(docs.select("doc_id", "text", (crc_mod(F.col("doc_id"), 7) != 2).alias("train")))


def op5_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_components(table(spark, sf_dir, "documents"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.find_personal(table(spark, sf_dir, "documents"))


def op8_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    found = languages.identify(docs, languages.fit(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"), F.col("__entropy").alias("entropy"), F.col("__rejected").alias("rejected"))


def page_captures(pages: DataFrame) -> DataFrame:
    """Captures of every page by rule of its id: a full response at time 20 id, and revisits at 20 id + 1, + 700 and - 5.

    A response's validators are its title's digest and, but for each third id, an etag made of title and language. Revisits
    show those of their page, but: every fifth page's lack the etag, every seventh's lack the digest, every eleventh's
    have another digest and every thirteenth's another etag. So of the later captures of a URL some agree with the latest
    response before them, some don't, some share no validator with it, and the earliest have none before them.
    """
    id_, text = F.col("page_id"), F.coalesce("html", F.lit(""))
    title = F.regexp_extract(text, "<title>([^<]*)</title>", 1)
    none = F.lit(None).cast("string")
    rows = pages.select(id_.alias("page"), "url", F.regexp_extract(text, r'<html lang="([a-z]*)"', 1).alias("lang"), title.alias("title"), F.length(text).cast("string").alias("size"))
    etag = F.md5(F.concat("title", "lang"))
    of = lambda k: F.col("page") % k == 0
    full_headers = F.create_map(F.lit("date"), (F.col("page") * 20).cast("string"), F.lit("content-length"), F.col("size"), F.lit("content-language"), F.col("lang"), F.lit("cache-control"), F.lit("max-age=60"))
    full = rows.select((F.col("page") * 4).alias("id"), "page", "url", (F.col("page") * 20).alias("at"), F.lit(True).alias("full"), F.when(~of(3), etag).alias("etag"), F.md5("title").alias("digest"), full_headers.alias("headers"))
    shown = F.when(of(5), none).when(of(13), F.md5(F.concat(F.lit("other "), F.col("title")))).when(~of(3), etag)
    digest = F.when(of(7), none).when(of(11), F.md5(F.concat(F.lit("other "), F.col("title")))).otherwise(F.md5("title"))
    when = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(d).alias("later")) for k, d in ((1, 1), (2, 700), (3, -5))))).alias("w")
    again = rows.select("page", "url", "lang", "title", when)
    at = F.col("page") * 20 + F.col("w.later")
    headers = F.create_map(F.lit("date"), at.cast("string"), F.lit("content-length"), F.lit("0"), F.lit("etag"), F.coalesce(shown, F.lit("-")))
    revisit = again.select((F.col("page") * 4 + F.col("w.k")).alias("id"), "page", "url", at.alias("at"), F.lit(False).alias("full"), shown.alias("etag"), digest.alias("digest"), headers.alias("headers"))
    return full.unionByName(revisit)


def op9_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = revisits.resolve(page_captures(table(spark, sf_dir, "pages")))
    header = lambda k: F.col("headers")[k].alias(k.replace("-", "_"))
    return found.select(F.floor(F.col("id") / 4).cast("long").alias("page_id"), (F.col("id") % 4).cast("int").alias("visit"), "canonical", F.floor(F.col("base_id") / 4).cast("long").alias("base_page_id"), "status", header("date"), header("content-length"), header("content-language"), header("cache-control"), header("etag"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    texts = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), vocabulary), vocabulary)
    return texts.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def secrets_rescan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.rescan(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_counts, op2_source_mix, op3_quality_rules, op4_lm_scores, op5_contamination, op6_jaccard_join, op7_personal_data, op8_languages, op9_revisits, op10_secrets, op11_phrases, op12_ranked_search, op13_bpe_round_trip, secrets_rescan)}

#: SQL of those that SQL can express; the others are held against brute force, the library or held-out rows in tests.
ORACLE: dict[str, str] = oracle.ORACLE
