"""Tables laid out for their readers: an index of urls by three-letter grams, and the registry in buckets by domain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .discovery import search
from .order import placed

#: Of a query's grams so many, the rarest, are looked up; what they find is checked exactly.
LOOKED_UP = 4


def grams(text: Column) -> Column:
    """The distinct runs of three code points of a lower-cased text; none below three."""
    low = F.lower(text)
    runs = F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: F.substring(low, i, F.lit(3)))
    return F.when(F.length(low) > 2, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def write_url_index(urls: DataFrame, path: str) -> None:
    """Below path: urls (number, url) in shards by ranges of urls; postings (gram, number) in shards by ranges of both,
    so that a gram which all urls hold lies in many shards; shards (shard, low, high): the grams that each holds;
    counts (gram, n). Null urls are left out; repeated ones count once."""
    mode = dict(mode="overwrite")
    u = placed(urls.select("url").where("url is not null").distinct(), "url", place="number").withColumn("shard", F.spark_partition_id())
    u.write.partitionBy("shard").parquet(f"{path}/urls", **mode)
    spark = urls.sparkSession
    u = spark.read.schema("number long, url string, shard int").parquet(f"{path}/urls")
    p = placed(u.select(F.explode(grams(F.col("url"))).alias("gram"), "number"), "gram", "number", place="_p").drop("_p").withColumn("shard", F.spark_partition_id())
    p.write.partitionBy("shard").parquet(f"{path}/postings", **mode)
    p = spark.read.schema("gram string, number long, shard int").parquet(f"{path}/postings")
    p.groupBy("shard").agg(F.min("gram").alias("low"), F.max("gram").alias("high")).coalesce(1).write.parquet(f"{path}/shards", **mode)
    p.groupBy("gram").agg(F.count("*").alias("n")).sort("gram").write.parquet(f"{path}/counts", **mode)


def search_index(spark: SparkSession, path: str, query: str) -> DataFrame:
    """The urls of an index that hold the query, whatever its case: what `discovery.search` finds.

    The query's rarest grams give candidates, each url that has all of them; an exact
    test decides. Only shards with these grams are read, and of the urls only those
    with candidates. A query of fewer than three code points is a scan.
    """
    urls = spark.read.schema("number long, url string, shard int").parquet(f"{path}/urls")
    asked = spark.range(1).select(grams(F.lit(query))).first()[0]
    if not asked:
        return search(urls.select("url"), query)
    known = spark.read.parquet(f"{path}/counts").where(F.col("gram").isin(asked)).collect()
    if len(known) < len(asked):
        return urls.select("url").limit(0)
    rare = sorted(r["gram"] for r in sorted(known, key=lambda r: (r["n"], r["gram"]))[:LOOKED_UP])
    within = [(F.col("low") <= g) & (F.col("high") >= g) for g in rare]
    # a row for each shard that holds one of the grams
    shards = [r["shard"] for r in spark.read.parquet(f"{path}/shards").where(_any(within)).collect()]
    postings = spark.read.schema("gram string, number long, shard int").parquet(f"{path}/postings")
    found = postings.where(F.col("shard").isin(shards) & F.col("gram").isin(rare)).groupBy("number").agg(F.count("*").alias("n")).where(F.col("n") == len(rare))
    # a number's high bits are its shard
    found = found.select("number", F.shiftright("number", 33).cast("int").alias("shard"))
    return search(urls.join(found, ["shard", "number"], "left_semi").select("url"), query)


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def write_registry(sitemaps: DataFrame, urls: DataFrame, name: str, buckets: int, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The registry's tables <name>_sitemaps and <name>_urls (urls with scraped, see `registry.with_scraped`), in
    buckets by domain; urls sorted by domain, priority (highest first) and url. Returns them.

    One domain's pages read one bucket; progress by domain groups and joins without a
    shuffle. A domain with a very large share of all urls is one bucket file, in as
    many row groups as it fills, which several tasks read; its pages are a top-k.
    """
    spark = urls.sparkSession

    def write(df: DataFrame, table: str, *order: str) -> DataFrame:
        at = {"path": f"{path}/{table}"} if path else {}
        df.repartition(buckets, "domain").write.mode("overwrite").format("parquet").options(**at).bucketBy(buckets, "domain").sortBy(*order).saveAsTable(table)
        return spark.table(table)

    ranked = urls.withColumn("_rank", F.coalesce(-F.col("priority"), F.lit(float("inf"))))
    return write(sitemaps, f"{name}_sitemaps", "domain"), write(ranked, f"{name}_urls", "domain", "_rank", "url").drop("_rank")
