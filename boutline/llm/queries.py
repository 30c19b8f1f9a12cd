"""Registered queries of this subpackage, each over its whole table, with its SQL where SQL can
express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from boutline.llm import alignment, conversations, decontaminate, jaccard, language, licenses, mixing, oracles, pii, quality, secrets
from boutline.llm import substrings, tokens, warc
from boutline.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


@query("op1_quality_rules")
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op2_jaccard_join", oracles.JACCARD_JOIN)
def jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.jaccard_join(table(spark, sf_dir, "documents"), words_in=3, percent=90)
    return found.select("doc_id", "n_shingles", "component_id")


@query("op3_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


@query("op4_decontaminate", oracles.DECONTAMINATE)
def benchmark_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_near")


@query("op5_pii")
def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(pii.find_pii(table(spark, sf_dir, "documents")))


@query("op6_secrets")
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets_digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


@query("op7_token_counts")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op8_licenses")
def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


@query("op9_substring_dedup", oracles.SUBSTRING_DEDUP)
def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


@query("op10_mix_sources", oracles.MIX_SOURCES)
def mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


@query("op11_repair_conversations")
def repaired_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_report(table(spark, sf_dir, "conversations"))


@query("op12_warc", oracles.WARC)
def archived_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op13_align_tokenizers")
def aligned_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.align_tokenizers(table(spark, sf_dir, "documents"), *paths)
