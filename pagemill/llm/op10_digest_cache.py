"""Token counts through a digest cache.

Each text's SHA-256 and the tokenizer's version digest are joined to stored
counts; the distinct texts that the cache lacks are encoded once each and
appended; every row then takes its count from the cache. Normalisation before
the digest is what the tokenizer itself applies to a text, which for plain
byte-level BPE is nothing, so equal digests mean equal counts.

Digests are joined to the cache first, as narrow rows; texts are looked at again
only for what is missing there. Up to BROADCAST_MISSES missing digests are
broadcast to the texts, so that a warm cache shuffles no text that it knows;
where more are missing, texts meet them in a shuffle. Missing texts are
pre-aggregated: a group of copies crosses the shuffle once for each map task.
With an empty cache all digests are missing and no join is needed.

Defined results: a null text counts as empty (0 tokens); a very long text is one
row and encoded whole; equal texts share a digest; null ids and repeated rows keep
their rows; an empty table gives an empty result; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import exists, scratch, whole_text, written

#: Missing digests, 32 bytes each, that are broadcast at most.
BROADCAST_MISSES = 2**20
CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"


def _counter(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, _ = tokens.load(path)
        for b in batches:
            counts = [len(encode(x.as_py())) for x in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    return run


def read_cache(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame:
    """(digest, n_tokens) of one tokenizer version, each digest once: runs that
    appended at the same time may have stored one twice."""
    if not exists(spark, cache):
        return spark.createDataFrame([], "digest binary, n_tokens long")
    return spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == tokenizer).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, path: str, cache: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row; appends misses to the cache."""
    spark = docs.sparkSession
    v = tokens.version(path)
    rows = docs.select("doc_id", whole_text().alias("text")).withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    narrow = written(rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest"), "count-rows")
    texts = rows.select("digest", "text")
    if exists(spark, cache):
        missing = written(narrow.select("digest").distinct().join(read_cache(spark, cache, v), "digest", "left_anti"), "count-misses")
        n = missing.count()
        texts = texts.join(F.broadcast(missing) if n <= BROADCAST_MISSES else missing, "digest", "left_semi") if n else None
    if texts is not None:
        counted = texts.dropDuplicates(["digest"]).select("digest", "text").mapInArrow(_counter(path), "digest binary, n_tokens long")
        counted.select(F.lit(v).alias("tokenizer"), "digest", "n_tokens").write.mode("append").option("compression", "zstd").parquet(cache)
    known = written(read_cache(spark, cache, v), "counts")
    return narrow.join(known, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op10_digest_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents by byte_bpe_50k.json, from an empty cache."""
    import public_tokenizers

    from .common import table

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), scratch(spark, "token-cache"))
