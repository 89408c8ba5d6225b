"""A corpus pipeline: each stage works on all that the one before it kept.

Documents that the toxicity classifier rejects go; of each near-duplicate group
one document stays; documents that hold benchmark passages go; secrets are
replaced in the texts; what remains is encoded.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import secret_scan, simhash, sp_dropout, toxicity, winnow
from lodestar.llm.common import durable, prepare, table


# Of all stages: null texts count as empty texts, rows with null keys and rows
# that repeat are documents of their own, an empty table gives an empty one of the
# same columns, and columns of any other names pass through.  Texts are taken
# whole, however long.


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels of ``docs``, does not reject.

    Null and empty texts are clean.  Without labels the fixed lexicon decides.
    """
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest key (null keys last).

    Links are pairs whose sets of five-word shingles have Jaccard similarity 0.8
    or more.  Texts without words are alike; of rows with equal key and text one
    stays, whichever.
    """
    prepare(spark)
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with any benchmark item; null and empty texts share none."""
    return winnow.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced in ``text``; ``n_chars`` is that of the new text (null for null)."""
    prepare(spark)
    return secret_scan.redact(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_chars, n_pieces, lossless, ids`` of all documents; null and empty texts have no ids.

    Rows with equal key and text get equal ids.
    """
    prepare(spark)
    found = sp_dropout.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_chars", F.size("ids").cast("long").alias("n_pieces"), "lossless", "ids")


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("secrets", redact_secrets),
    ("sentencepiece", encode),
]

#: Classifier, near duplicates and encoding have no SQL form; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), name)
    return docs
