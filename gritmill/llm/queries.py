"""Registers the queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gritmill.llm.formdup import collapsed_records, form_duplicates
from gritmill.llm.history import repeats_of_history
from gritmill.llm.levels import reading_levels
from gritmill.llm.mixing import mix, mix_shares
from gritmill.llm.secrets import found_places, masked_snippets
from gritmill.llm.tokens import decode_corpus, encode_corpus
from gritmill.plans.registry import query
from gritmill.session import table


@query("p5_found")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return form_duplicates(table(spark, sf_dir, "report"))


@query("p5_records")
def p5_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapsed_records(table(spark, sf_dir, "report"))


@query("p1_found")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats_of_history(table(spark, sf_dir, "report"))


@query("p6_ids")
def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"))


@query("p6_decoded", "SELECT doc_id, coalesce(text, '') AS text FROM documents")
def p6_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The round trip through ids gives every text back."""
    return decode_corpus(encode_corpus(table(spark, sf_dir, "documents")))


@query("p7_mix")
def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


@query("p7_shares")
def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_shares(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


@query("p8_found")
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_levels")).select("doc_id", "reading_level")


def _scanned(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [table(spark, sf_dir, t) for t in ("report", "gitleaks", "trivy")]


@query("p4_found")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_places(*_scanned(spark, sf_dir))


@query("p4_masked")
def p4_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked_snippets(*_scanned(spark, sf_dir))
