"""A corpus pipeline of four of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs. All but the last return the
columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pagemill import ship
from pagemill.llm.common import scratch, table
from pagemill.llm.near_texts import one_of_each
from pagemill.llm.op3_bradley_terry import keep_good
from pagemill.llm.op7_chunked_bpe import encode_documents
from pagemill.llm.op8_mixing import mixed_rows


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labelled
    documents of the whole table, as some may be missing from docs. Null, empty
    and very long texts are scored whole like any other; null ids and repeated rows
    are judged by their text; a document whose score is the cut's stays; an empty
    table gives an empty result; other columns stay as they are, whatever their
    names."""
    return keep_good(docs, table(ship(spark), sf_dir, "labels"), table(spark, sf_dir, "documents"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id:
    five-word shingles, a similarity of 0.8 or more. op6_simhash's fingerprints of these
    shingles link close copies, bands of minhashes what lies further apart; each link
    is verified. (The query op6_simhash takes three-word shingles and two bits alone.)
    A row with a null id stays where its group has no other; rows of one id with
    different texts are different documents; of equal rows one stays; null, empty
    and white texts are one group; very long texts are compared whole; an empty
    table gives an empty result; other columns stay as they are, whatever their
    names."""
    ship(spark)
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, dropped or repeated so that sources meet their targets.
    Null sources are one source; null texts have no words and follow the cut of
    their source; each row stands for itself, whatever it shares with others, and
    rows of one key at a cut are taken by a hash of the row; a very long text on a
    cut stays if at least half of it is taken; an empty table gives an empty result;
    other columns stay as they are, whatever their names."""
    ship(spark)
    return mixed_rows(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text, for every row.
    A null text is empty; very long texts are encoded whole; repeated rows and null
    ids have rows of their own; an empty table gives an empty result; other columns
    are left out, whatever their names."""
    ship(spark)
    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("mixing", mixing), ("bpe", bpe)]

#: The classifier, fingerprints and token ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written in the shared folder."""
    docs = table(ship(spark), sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
    return docs
