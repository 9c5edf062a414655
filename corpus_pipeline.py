"""Corpus pipeline: quality classifier, exact dedup, n-gram Jaccard dedup, secret redaction, packing.

``STAGES`` lists (name, function); each function takes ``(spark, docs, sf_dir)`` and returns a
DataFrame that is written as Parquet and reread as the next one's ``docs``. All but the last return
the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labelled ones outside the held-out fifth."""
    from netflow_spark.llm.quality import keep_good
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of identical texts the document with the largest id stays, in one row."""
    from netflow_spark.llm.exact_dedup import drop_exact_copies
    return drop_exact_copies(docs, one_each=True)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by word 5-grams at Jaccard 0.8 or more the one with the smallest id stays."""
    from netflow_spark.llm.jaccard_join import drop_near_copies
    return drop_near_copies(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; no document goes."""
    from netflow_spark.llm.secrets import redact
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and the sequences they are packed into."""
    import public_tokenizers

    from netflow_spark.llm.packing import pack
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_classifier", quality), ("exact_dedup", exact_copies), ("ngram_jaccard_join", near_copies),
          ("secret_scan", secrets), ("best_fit_packing", packing)]

#: The classifier is trained, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netflow_spark.llm.common import written
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
