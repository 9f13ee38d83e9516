"""A corpus pipeline of five stages, each over all rows that the one before has kept.

Every stage takes (spark, docs, sf_dir); run() writes its rows as Parquet in the shared folder and reads them back as the
next one's docs, so a lost executor costs at most one stage's tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loamline.llm import bpe, decontaminate, ngram_join, pii, quality
from loamline.llm.common import cut, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that fail the base rules or any further one go.

    Null and empty texts have no words, so they go; texts of any length are judged whole; each of several equal rows
    is judged alike; ids aren't looked at, so null ones do no harm; an empty table stays empty.
    """
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, a similarity of 0.8) the row with the least id stays.

    Rows are told apart by id and text: equal rows count once, rows that only share an id each for itself. Null ids come
    last, ties go by a digest. Null and empty texts are like nothing and stay; an empty table stays empty.
    """
    return ngram_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold ten consecutive words of a benchmark item, or all of a shorter one, go.

    Null and empty texts hold nothing and stay; equal rows go or stay alike; null ids do no harm; without items, or
    without rows, nothing changes.
    """
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind in angle brackets; n_chars follows the text.

    Every row stays. Null and empty texts are as they were, with an n_chars of 0; equal rows get equal texts.
    """
    return pii.redact(docs, length_col="n_chars")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token count and digests of the encoded and decoded text of each row.

    Null and empty texts have no tokens and the digests of nothing; repeated rows and null ids stay; an empty table has no rows.
    """
    return bpe.digest(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("BPE encoding and decoding", encoding),
]

#: Encoding can't be expressed in SQL; tests hold each stage against a plain-Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = cut(docs) if k + 1 < len(STAGES) else docs
    return docs
