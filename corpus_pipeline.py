"""From raw documents to token ids: language, copies, near copies, mixture, pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of the documents. ``run`` writes every stage as Parquet in the shared folder and rereads it, so a
lost executor repeats no earlier stage. Every stage works on all that the one before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cityloom.llm.common import written
from cityloom.llm.exact_dedup import drop_exact_duplicates
from cityloom.llm.jaccard_join import drop_near_duplicates
from cityloom.llm.language_id import keep_known_languages
from cityloom.llm.mixing import mixture
from cityloom.llm.sentence_pieces import default_model, encode, read_model
from cityloom.session import ship


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters, or in no language that the network is at all sure of, go."""
    return keep_known_languages(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the row with the largest doc_id stays."""
    return drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each pass that serves a document; a cut-off document keeps the words served."""
    mixed = mixture(docs)
    if "n_chars" in docs.columns:
        mixed = mixed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return mixed


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, n_bytes of every row."""
    return encode(docs, read_model(default_model()))


def _shipping(stage):
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return stage(spark, docs, sf_dir)
    return run_stage


STAGES = [(name, _shipping(stage)) for name, stage in (
    ("language_id", language), ("exact_dedup", exact), ("jaccard_join", near), ("mixing", mix),
    ("sentencepiece", pieces))]

#: A network, MinHash and a vocabulary are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
