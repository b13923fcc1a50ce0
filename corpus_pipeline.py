"""The training-data pipeline: documents are filtered, cleaned, deduplicated, freed of secrets and packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. Stage results are written to the shared folder and read again. Where a stage changes a text, it
sets n_chars to the new length.

What is so in every stage: an empty table gives an empty table. Columns besides those of documents are not passed
on and may have any name. Null lang, source and n_chars stay null. Rows are rows: those that repeat an id, a text or
both are each judged (only near_dedup leaves one of them), and rows without an id are judged like others. Texts are
processed whole, however long.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronopanel.llm import near_copies, packing, quality_cnn, quality_rules, secrets
from chronopanel.llm.common import stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of good quality is at least one half. A null or empty text is scored as empty and
    stays as it is if kept; where no text has a label of each class, the share of label 1 decides for all."""
    model = quality_cnn.fit(docs, table(spark, sf_dir, "labels"))
    return quality_cnn.score(docs, model).where("score >= 0.5").select(*COLUMNS)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without the lines that fail. Null, empty and blank texts have no word and go."""
    cleaned = quality_rules.clean(docs).where("kept")
    changed = ~F.col("cleaned").eqNullSafe(F.col("text"))
    return cleaned.withColumns({"n_chars": F.when(changed, F.length("cleaned").cast("bigint")).otherwise(F.col("n_chars")), "text": F.col("cleaned")}).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 or more. That of the smallest
    id stays (no id comes last), of equal ids that of the smallest hash of its text, of repeated rows one. All texts
    without words (null, empty, blank) are one group; texts of fewer than five words are one shingle."""
    return near_copies.one_of_each(docs).select(*COLUMNS)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced by a mark. Overlapping secrets are one stretch and get one
    mark; null texts stay null."""
    scanned = secrets.scan(docs).withColumn("__found", F.size("spans") > 0)
    clean = secrets.redact(scanned)
    return clean.withColumn("n_chars", F.when(F.col("__found"), F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of tokenised documents with their sequence and offset. A null or empty text is the closing id alone."""
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", rules),
    ("near_dedup", near_dedup),
    ("secret_scans", secret_scans),
    ("packing", pack),
]
#: Neither the classifier's training nor fingerprints and greedy packing can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
