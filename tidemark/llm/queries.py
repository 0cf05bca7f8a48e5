"""Registered queries of the subpackage, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import divergence, infill, urls
from tidemark.llm.common import table
from tidemark.llm.decontamination import leaks
from tidemark.llm.fingerprints import edited_fingerprints
from tidemark.llm.jaccard import near_duplicates
from tidemark.llm.packing import packed
from tidemark.llm.pii import pii_digest
from tidemark.llm.quality import quality
from tidemark.llm.suffix_array import dedup_bytes
from tidemark.llm.suffix_tree import dedup_words
from tidemark.llm.tokens import token_counts
from tidemark.llm.toxicity import toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """A public vocabulary file, installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def register(name: str, sql: str | None = None):
    def keep(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


@register("op1_decontamination")
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op2_suffix_array_dedup")
def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_bytes(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@register("op3_substring_dedup")
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_words(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


@register("op4_ngram_jaccard_join")
def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@register("op5_packing")
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), vocabulary())


@register("op6_token_counts")
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary())


@register("op7_personal_data")
def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(table(spark, sf_dir, "documents"))


@register("op8_document_fingerprints")
def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


@register("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op10_url_filters", urls.SQL)
def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.page_verdicts(table(spark, sf_dir, "pages"))


@register("op11_fill_in_middle", infill.SQL)
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.infill_digests(table(spark, sf_dir, "documents"))


@register("op12_quality_classifier")
def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op13_source_divergence", divergence.SQL)
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))
