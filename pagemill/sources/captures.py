"""Readers of captured data, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CAPTURES = "url string, html string, status_code int, method string, encoding_error boolean, fetched_at timestamp_ntz"
DISCOVERED = "url string, discovered_from string, timestamp string, source_title string"
SERP = "query string, raw_pos int, title string, href string, snippet string"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def captures(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """Captured pages; a page that could not be fetched has null html and status 0."""
    return spark.read.schema(CAPTURES).format(format).load(path)


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """url of each line that is neither blank nor starts with #."""
    line = F.col("value")
    return spark.read.text(path).where(~line.startswith("#") & line.rlike(r"(?U)\S")).select(F.regexp_replace(line, r"(?U)^\s+|\s+$", "").alias("url"))


def discovered_json(spark: SparkSession, path: str) -> DataFrame:
    """The table of discovered urls from a JSON object of url to its record; empty where the file is broken."""
    record = "map<string, struct<discovered_from string, timestamp string, source_title string>>"
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", record)).alias("url", "r")).select("url", "r.*")


def sources_json(spark: SparkSession, path: str) -> DataFrame:
    """ord, url from a JSON array; empty where the file is broken."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.posexplode(F.from_json("value", "array<string>")).alias("ord", "url")).select(F.col("ord").cast("long").alias("ord"), "url")
