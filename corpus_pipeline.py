"""A training-data pipeline over ``documents``: rules, line dedup, near-dedup, secrets, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's ``docs``. All but the last return the columns of ``documents``.

In every stage an empty table gives an empty table, other columns of any name are carried, and rows that repeat an id
are judged row by row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import line_dedup, packing, quality, secrets, simhash
from millrace.session import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule or are depleted of lines go; the others lose their host's boilerplate lines.

    Null and empty texts have no words and go; rows with a null host are one host.
    """
    return quality.accepted(docs)


def line_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that other documents hold stay in the first of them only. All rows stay: null ids and null texts as they are."""
    return line_dedup.without_repeats(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, by SimHash links and an exact join across their groups, the document with the smallest id stays.

    Null, empty and blank texts are one group; rows with a null id stay.
    """
    return simhash.keep_one(docs, words=5, similarity=0.8)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced with a mark; all documents stay, null texts and texts without a secret as they are."""
    return secrets.redact(docs)


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2,048 tokens and their places in sequences; a null or empty text is the end id alone."""
    return packing.pack(docs).withColumnRenamed("id", "doc_id").withColumnRenamed("crc", "ids_crc32")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_repeats),
    ("simhash_near_dedup", near_duplicates),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit),
]

#: SimHash needs XXH64 and packing a tokenizer, neither of which SQL has.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
