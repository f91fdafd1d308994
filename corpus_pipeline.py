"""The corpus pipeline: documents that are good, of one kind each, not of a benchmark, without personal data, packed.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; the first four return the
columns of documents, the last one the pieces of its sequences.  ORACLE_SQL is None: tokens, surrogates
and trained scores are beyond SQL, so tests hold run() against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillprint.llm import decontam, neardup, packing, pii, quality
from rillprint.llm.common import fresh, read_table, written


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labels of docs, does not reject."""
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each near-duplicate group (five words, similarity 0.8).

    Rows that repeat that doc_id all stay, as do rows with a null doc_id and texts without words.
    """
    groups = neardup.group_documents(docs)
    return docs.join(groups.where("NOT kept").select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item; null and empty texts cover none."""
    return decontam.clean(docs, read_table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data; n_chars follows the text. Null texts stay null."""
    new = pii.with_surrogates(docs, pii.surrogate_key(spark), counts=(found := fresh("n_entities", docs)))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new = new.withColumn("n_chars", F.when(F.col(found) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return new.select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, repeated rows and null texts too, in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_classifier", keep_good_quality),
    ("minhash_near_dedup", keep_one_of_each_group),
    ("benchmark_decontamination", drop_contaminated),
    ("pii_surrogates", replace_personal_data),
    ("best_fit_packing", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again as the next one's input."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
