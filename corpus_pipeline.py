"""A training corpus in five stages: quality, near-duplicates, benchmark leaks, secrets, tokens.

Every stage works on all rows that its predecessor kept; the next one reads them
back from Parquet in the shared folder.

Cases, alike in all stages: columns may be null; columns beyond those of documents
are left out, whatever their names; an empty table stays empty; texts of any length
are worked on whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodespark.llm import decontaminate, neardup, pieces, quality, secretscan
from lodespark.llm.catalogue import table, vocabulary
from lodespark.session import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep: null, empty and blank texts go (fewer than 50 words), repeated rows share their fate."""
    docs = docs.select(*COLUMNS)
    weight = quality.weights(docs, table(spark, sf_dir, "labels"))
    others = tuple(c for c in COLUMNS if c != "text")
    return quality.judge(docs, weight, keep=(*others, "text")).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the least id (a null one first), of equal ids the least text by MD5, once; blank texts all stay."""
    return neardup.one_of_each(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage; others under the same id, null or not, stay; null and empty texts stay."""
    hit = decontaminate.overlaps(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_hit"), F.col("text_md5").alias("_text")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_hit")) & (F.unhex(F.md5("text")) == F.col("_text"))
    return docs.select(*COLUMNS).join(hit.hint("merge"), same, "left_anti")


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret masked; null and empty texts as they are, repeated rows alike."""
    return secretscan.masked(docs.select(*COLUMNS))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document, a row for each; a null or empty text has no tokens."""
    return pieces.encode(docs, vocabulary("piece_bpe_32k.model"), keep_ids=False)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret scans", secret_scans),
    ("sentencepiece", sentencepiece),
]
#: The n-gram hash, the sampling and the merges have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, "stage")
    return docs
