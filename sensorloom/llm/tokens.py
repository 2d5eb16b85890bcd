"""Token counts with a digest cache: texts are counted once per tokenizer version, whatever table they come in."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .common import digest, shared_path, small_batches, whole_text

CACHE_SCHEMA = "content binary, tokenizer string, n_tokens long"


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer's file: another file, another version."""
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def counter(path: str):
    """A function from a list of texts to their token counts, as the file's own library gives them."""
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_padding()
        tokenizer.no_truncation()
        return lambda texts: [len(x.ids) for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
    from sentencepiece import SentencePieceProcessor

    pieces = SentencePieceProcessor(model_file=path)
    return lambda texts: [len(pieces.encode(x)) for x in texts]


def count_texts(texts: DataFrame, path: str, version: str) -> DataFrame:
    """Cache rows (content, tokenizer, n_tokens) of rows (content, text)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            numbers = count([x or "" for x in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column("content"), pa.array([version] * len(numbers), pa.string()), pa.array(numbers, pa.int64())],
                ["content", "tokenizer", "n_tokens"])

    return texts.select("content", "text").mapInArrow(counted, CACHE_SCHEMA)


def count_tokens(documents: DataFrame, path: str, cache: str | None = None, limit: int = 4096) -> DataFrame:
    """Tokens of every whole text, one row per row of `documents`: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Texts are joined by content digest and tokenizer version to the cache, a folder of Parquet files in shared
    storage; distinct texts it does not hold are encoded once and appended to it. The content that is digested
    is the text itself, as a count must be the library's for exactly these characters; only null becomes the
    empty text. Begin and end tokens are not counted; special strings in a text are handled as the library does.

    Null doc_id: kept, like repeated rows: each row has its result. Empty text: 0 tokens. An empty table gives an
    empty result. Other columns are not looked at and not returned. Copies are folded before the shuffle; a text
    that many rows share reaches one task once.
    """
    spark = documents.sparkSession
    small_batches(spark)
    version = tokenizer_version(path)
    cache = cache or shared_path(spark, "token-cache")
    texts = documents.select(F.col("doc_id"), whole_text().alias("text")).withColumn("content", digest(F.col("text")))

    def held() -> DataFrame:
        rows = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == version)
        # two runs at once may both have appended a text
        return rows.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))

    misses = texts.groupBy("content").agg(F.max("text").alias("text"))
    try:
        misses = misses.join(held().select("content"), "content", "left_anti")
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
    count_texts(misses, path, version).write.mode("append").parquet(cache)
    sizes = texts.select("doc_id", "content", F.octet_length("text").cast("long").alias("n_bytes"))
    return sizes.join(held(), "content").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
