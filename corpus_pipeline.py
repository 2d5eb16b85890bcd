"""A training-data pipeline: documents without toxic ones, repeated lines and near copies, mixed by source, in token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.llm.common import stored
from sensorloom.llm.lines import dedup_lines
from sensorloom.llm.minhash import without_near_duplicates
from sensorloom.llm.mixing import mixed_documents
from sensorloom.llm.pieces import encode
from sensorloom.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model fitted on the labels doesn't call toxic.

    Null and empty texts, and texts without words, score 0 and stay; rows without doc_id and repeated rows stay or go by
    their text. Without labels of both kinds, all documents with words score as the labels there are (none: they stay).
    """
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without later copies of repeated line runs; n_chars follows the text.

    No row goes: a document whose lines are all copies stays with an empty text. Null stays null (n_chars too), empty
    stays empty. Of repeated rows the later ones lose the repeated lines.
    """
    return dedup_lines(docs).select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest doc_id.

    Documents with null or empty text or without words are near nothing and stay; rows that repeat doc_id and text stay
    once; rows without doc_id stay.
    """
    return without_near_duplicates(docs, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix by source weights takes them: not at all, once or twice.

    A null source is a source of its own, the last. Documents without words (null and empty ones too) come at most once,
    as they add nothing. All columns are kept. Rows that share doc_id, source and number of words come equally often.
    """
    return mixed_documents(docs, weights=[3, 1, 2], share=1.5, most=2)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mix, and whether they decode to its text, one row per row.

    Null or empty text: no ids, and round_trip is true. Rows without doc_id or source are kept.
    """
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    read = encode(docs.select("doc_id", "source", "text"), path, verify=True)
    return read.select("doc_id", "source", F.size("ids").alias("n_tokens"), "ids", "round_trip")


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("mixing", mixing), ("pieces", pieces)]

# The fitted model and the tokenizer can't be written in SQL; the stages are tested one by one instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder; each stage's rows are written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
