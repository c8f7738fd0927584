"""The corpus pipeline: quality classifier, line dedup, near-duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the
columns of documents. Documents that the classifier rejects, near copies of a document that stays (a similarity of 0.8 of five-word shingles), and
documents that a benchmark window hits go whole; repeated lines go from within texts. A document whose lines are all repeats goes on with an empty text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftnet.llm import decontaminate, packing, quality, similar, spans
from driftnet.storage import fresh_path, remove, written


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, fitted on the table labels, accepts.

    A null or empty text is rated by the thresholds alone; equal rows are rated alike and all stay or all go; without labels all stay. An empty table
    gives an empty one; columns beyond those of documents are left out.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _as_documents(quality.classify(docs, labels).where("accepted"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that a later occurrence of a repeated window of three lines covers.

    Of equal windows the one with the smallest doc_id, then text hash, then place stays, a null doc_id first. Null and empty texts stay as they are;
    equal rows count once and get the same text. An empty table gives an empty one; columns beyond those of documents are left out.
    """
    return _as_documents(spans.dedup_lines(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that a similarity of 0.8 or more of their five-word shingles connects, the one with the smallest doc_id.

    Candidates are SimHash fingerprints within two bits, by operator 7's blocks, then bands of least hashes for what these cannot tell; all are verified.
    Of several such the one with the smallest text hash stays, and of equal rows one; null doc_ids come last. Texts without words (null, empty, white
    space) are one group. An empty table gives an empty one; columns beyond those of documents are left out.
    """
    return _as_documents(similar.dedup_similar(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in which no window of ten words of the table benchmark stands.

    Null and empty texts have no words and stay; equal rows all stay or all go. An empty benchmark removes nothing, an empty table
    gives an empty one; columns beyond those of documents are left out.
    """
    return _as_documents(decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document, with its sequence and place there, as of ``packing.pack_documents``.

    A null or empty text is the end token alone; equal rows are documents of their own. An empty table gives an empty one; other columns are
    left out.
    """
    return packing.pack_documents(docs)


def _as_documents(docs: DataFrame) -> DataFrame:
    """The columns of documents, n_chars by the text as it now is."""
    return docs.selectExpr("doc_id", "text", "lang", "source", "cast(length(text) AS bigint) AS n_chars")


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", best_fit_packing),
]
#: SQL cannot express the classifier and the packing; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; what each keeps is a Parquet table in the shared folder until the next one's is written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs, before, last = written(stage(spark, docs, sf_dir), path := fresh_path(spark)), last, path
        if before is not None:
            remove(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)
