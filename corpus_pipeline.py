"""The corpus pipeline: quality rules, near-dedup, decontamination, secret scan, packing.

In every stage a null text counts as an empty one and an empty table gives no rows; texts of
any length are read whole, and columns beyond doc_id and text are kept as they are, whatever
their names, by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kindred import storage
from kindred.llm import decontaminate, minhash, packing, queries, repetition, secrets


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules reject go, null and empty texts among them; repeated rows are
    judged each, and measures that equal a limit pass."""
    return repetition.drop_repetitive(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) one document stays,
    the one with the smallest doc_id; of rows that repeat a doc_id the one with the least text; rows
    without doc_id stay."""
    return minhash.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, with or without doc_id; items without words match nothing,
    and repeated rows are searched each."""
    return decontaminate.drop_contaminated(docs, queries.table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark; all documents stay, null texts as they are;
    of secrets that overlap the first gives the place."""
    return secrets.redact_secrets(docs)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: a row for each piece of a document; an empty text has its end id alone, and
    repeated rows are packed each."""
    return packing.pack(docs, queries.word_tokenizer())


STAGES = [("quality rules", quality_rules), ("near-dedup", near_dedup), ("decontamination", decontamination), ("secret scan", secret_scan), ("packing", pack_documents)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = storage.saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Suffix arrays, MinHash and tokenizers have no SQL form; tests compare with brute force.
ORACLE_SQL = None
