"""The queries ``opN_<name>``: each applies its operator with production parameters to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumenframe.llm import decontam, divergence, fillmiddle, langid, linededup, orderminhash, packing, pagetext, piecebpe, pii, simhash, tokenfile, toxicity
from lumenframe.llm.tables import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return linededup.site_line_dedup(docs).select("doc_id", "source", "text", "n_lines", "n_dropped")


def op1_line_dedup_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Besides a site's lines also the long ones that repeat over all sites; ``op1_line_dedup`` is held to its SQL."""
    docs = table(spark, sf_dir, "documents")
    return linededup.site_line_dedup(docs, passages=True).select("doc_id", "source", "text", "n_lines", "n_dropped")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagetext.extract_pages(table(spark, sf_dir, "pages"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontam.digest(found)


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orderminhash.fingerprints(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.token_digest(table(spark, sf_dir, "documents"))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piecebpe.round_trip(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fillmiddle.fill_digest(table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op1_line_dedup_passages": op1_line_dedup_passages,
    "op2_decontamination": op2_decontamination,
    "op3_order_minhash": op3_order_minhash,
    "op4_language_id": op4_language_id,
    "op5_packing": op5_packing,
    "op6_pii": op6_pii,
    "op7_toxicity": op7_toxicity,
    "op8_page_text": op8_page_text,
    "op9_simhash": op9_simhash,
    "op10_token_file": op10_token_file,
    "op11_sentencepiece": op11_sentencepiece,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_source_divergence": op13_source_divergence,
}

ORACLES: dict[str, str] = {
    "op1_line_dedup": linededup.SQL,
    "op2_decontamination": decontam.SQL,
    "op12_fill_in_middle": fillmiddle.SQL,
    "op13_source_divergence": divergence.SQL,
}
