"""Corpus pipeline: quality, near copies, benchmark passages, personal data, tokens.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and
works on all that the stage before kept. All but the last return the columns of
documents. ``run`` writes each stage's result as Parquet below the shared
folder and rereads it for the next.

Stages work on texts: a null text is the empty text, rows without doc_id are
kept by the near-copy stage, extra columns go along to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitewise.llm import decontaminate, ngram_join, ordinal, pieces, pii
from sitewise.llm.tables import read, tokenizer
from sitewise.session import shared_path

#: No SQL: a fitted classifier and a tokenizer are among the stages.
ORACLE_SQL = None

WANTED_GRADE = 2  # good and not toxic
LEVEL = 0.6  # least probability of the wanted grade


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose probability of the wanted grade is below LEVEL."""
    model = ordinal.fit_documents(docs, ordinal.ratings_of(read(spark, sf_dir, "labels")), levels=WANTED_GRADE + 1)
    return ordinal.select_documents(docs, model, WANTED_GRADE, LEVEL)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each component."""
    return ngram_join.keep_first(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that share a window of words with the benchmark."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by labels, and generalises or removes terms that
    disclose it."""
    return pii.sanitise(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids with the end id, and the text decoded from them."""
    return pieces.encode_documents(docs, tokenizer("piece_bpe_32k.model"))


STAGES = [
    ("quality", quality),
    ("near_copies", near_copies),
    ("benchmark_passages", benchmark_passages),
    ("personal_data", personal_data),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
