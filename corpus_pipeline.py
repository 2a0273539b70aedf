"""documents -> language ID -> quality rules -> near-duplicates -> packed sequences.

Each stage works on all rows its predecessor kept; what it decides takes effect: rejected documents go, and lines that
fail the quality rules leave the texts of the others. All other columns stay as they are until the last stage turns
rows into pieces of ids. Empty tables pass through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrun.llm.common import stash, table, unstash
from tallyrun.llm.hyperminhash import keep_one
from tallyrun.llm.langid_crf import keep_identified, train
from tallyrun.llm.line_rules import keep_clean
from tallyrun.llm.packing import pack


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter (so also null and empty ones) and those whose words fit no learned language go.

    If no text is labelled, no language is learned and every text goes.
    """
    return keep_identified(docs, train(docs))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base test or lose too much text to the line rules go; of the others the failing lines go.

    Null and blank texts go, as they fail the base test. `n_chars` follows the text.
    """
    cleaned = keep_clean(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cleaned


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays; of equal rows and of null ids alike one row."""
    return keep_one(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their token ids. A null text, which no stage before lets through, would be one piece of the end id."""
    return pack(docs, keep_ids=True)


STAGES = [("language_id", language_id), ("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("packing", packing)]

#: no stage but the second has an SQL form; tests hold the pipeline against a plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, stash(stage(spark, docs, sf_dir), name)
        unstash(before)
    return docs
