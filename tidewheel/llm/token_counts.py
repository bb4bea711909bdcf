"""Token counts through a digest cache.

The content (null as empty) and the tokenizer file each have a SHA-256 digest. Documents are
reduced to distinct digests before the shuffle, joined to the cache, and only digests that
the cache lacks are encoded, once each; their counts are appended as one Parquet commit. All
documents then take their count from the cache. A lost executor repeats tasks, not the commit.

Defined cases: null and empty texts have no bytes and the tokenizer's count for an empty text;
repeated rows share one cache entry and each get a row; an empty table gives an empty
result; a null doc_id is kept; a text of any length is encoded whole, about CHUNK_CHARS characters at once besides one text; extra columns are ignored. Content is not folded in any
other way, because counts depend on case, width and white space.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import chunks, map_arrow, materialize, out_batch, scratch, table

CACHE = "digest binary, tokenizer string, n_tokens bigint"


@lru_cache(maxsize=2)
def _piece_model(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def encoder(model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor = _piece_model(model)
        for batch in batches:
            for part, texts in chunks(batch):
                yield out_batch({"digest": part.column("digest"), "n_tokens": [len(x) for x in processor.encode(texts, num_threads=1)]}, {"n_tokens": pa.int64()})

    return run


def fill_cache(docs: DataFrame, cache_dir: str, model: bytes) -> DataFrame:
    """Appends counts for contents that the cache at cache_dir lacks; returns this tokenizer's part of it."""
    spark, version = docs.sparkSession, hashlib.sha256(model).hexdigest()
    spark.createDataFrame([], CACHE).write.mode("append").parquet(cache_dir)
    known = spark.read.schema(CACHE).parquet(cache_dir).where(F.col("tokenizer") == version).select("digest", "n_tokens")
    text = F.coalesce(F.col("text"), F.lit(""))
    distinct = docs.select(F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text")).groupBy("digest").agg(F.first("text").alias("text"))
    misses = distinct.join(known, "digest", "left_anti")
    counted = map_arrow(misses, encoder(model), "digest binary, n_tokens bigint")
    counted.select("digest", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache_dir)
    now = spark.read.schema(CACHE).parquet(cache_dir).where(F.col("tokenizer") == version)
    # two writers may have appended one digest; written, so that Spark can split a hot digest in the join that follows
    return materialize(now.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens")), "token-counts")


def token_counts(docs: DataFrame, cache_dir: str, model_path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document."""
    counts = fill_cache(docs, cache_dir, Path(model_path).read_bytes())
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(text, 256)).alias("digest"))
    return keyed.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts for piece_bpe_32k.model; its cache starts empty, so that no earlier run shows in the result."""
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), scratch(spark, "token-cache"), public_tokenizers.path("piece_bpe_32k.model"))
