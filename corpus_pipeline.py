"""The corpus pipeline: language ID, line dedup, SimHash near-dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; every stage but the last returns the
columns of ``documents``. ``ORACLE_SQL`` is None: hyperdimensional profiles and XXH64 have no SQL form; the tests hold
the stages against brute force.

Defined results: null, empty and letterless texts go in the first stage; null sources are a site of their own; of rows
with the same text, and of repeated ids, one stays; null ids are kept like any other; an empty table gives no piece;
further columns pass through all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenframe.llm import decontam, langid, linededup, packing, simhash
from lumenframe.llm.tables import bounded_batches, table
from lumenframe.plans.storage import materialize

ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no learnt language: without a letter, or predicted to be unlike all of them. A null ``lang`` becomes the predicted one."""
    bounded_batches(spark)
    return langid.known_language(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes boilerplate lines of each source and passages that repeat over all sources; all documents stay. ``n_chars`` follows the text where it was right before."""
    from pyspark.sql import functions as F

    rows = linededup.cleaned_rows(docs, passages=True, keep_repeated=True)
    count = F.when(F.col("n_dropped") > 0, F.char_length("cleaned").cast("long")).otherwise(F.col("row")["n_chars"])
    changed = {"text": F.col("cleaned"), "n_chars": count}
    return rows.select(*(changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each near-duplicate group."""
    bounded_batches(spark)
    return simhash.one_per_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents contaminated by the benchmark."""
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    bounded_batches(spark)
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
