"""The registry as stored tables, merged by batches of arriving sitemap files."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import host
from ..operators import registry, sitemap
from ..tables import discard, hadoop_path, written


class Store:
    """Tables sitemaps, urls and scraped below a folder.

    sitemaps lies in buckets of the domain, urls in buckets of the url's host, so a
    url is in one bucket whoever lists it and a batch's urls are in few. A merge
    reads the buckets that its rows touch and overwrites these alone (dynamic
    partition overwrite); the files of others stay. What a merge will write is
    staged first, whole; a run that ends between is finished from there when the
    store is opened or merged into again, and merging the same rows again changes
    nothing, so a batch may be run as often as it takes. scraped is a log: a folder
    for each batch, overwritten if that is run again. One writer at a time.
    """

    SCHEMAS = {"sitemaps": registry.SITEMAPS, "urls": registry.URLS, "scraped": registry.SCRAPED}

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        """The number of buckets must be the one that the store was made with."""
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self._finish()

    def _exists(self, path: str) -> bool:
        fs, p = hadoop_path(self.spark, path)
        return fs.exists(p)

    def _delete(self, path: str) -> None:
        fs, p = hadoop_path(self.spark, path)
        fs.delete(p, True)

    def bucket(self, table: str) -> Column:
        return F.pmod(F.hash("domain" if table == "sitemaps" else host(F.col("url"))), F.lit(self.buckets))

    def read(self, table: str) -> DataFrame:
        """A stored table; sitemaps and urls have a column bucket more, by which a reader can prune."""
        key = "batch long" if table == "scraped" else "bucket int"
        schema = f"{self.SCHEMAS[table]}, {key}"
        path = f"{self.path}/{table}"
        return self.spark.read.schema(schema).parquet(path) if self._exists(path) else self.spark.createDataFrame([], schema)

    def of_domain(self, domain: str) -> DataFrame:
        """The sitemaps row of a domain, from its bucket alone."""
        number = self.spark.range(1).select(F.lit(domain).alias("domain")).select(self.bucket("sitemaps")).first()[0]
        return self.read("sitemaps").where((F.col("bucket") == number) & (F.col("domain") == domain)).drop("bucket")

    def _replace(self, table: str, rows: DataFrame) -> None:
        """Overwrites the buckets of rows (with bucket), which hold all of these buckets."""
        staged = f"{self.path}/_staged/{table}"
        # a host with very many urls is written by several tasks
        rows.repartition("bucket", F.pmod(F.xxhash64("url" if table == "urls" else "domain"), F.lit(16))).write.mode("overwrite").parquet(staged)
        self._finish()

    def _finish(self) -> None:
        for table in ("sitemaps", "urls"):
            staged = f"{self.path}/_staged/{table}"
            if self._exists(f"{staged}/_SUCCESS"):
                rows = self.spark.read.parquet(staged)
                rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/{table}")
            self._delete(staged)

    def _touched(self, table: str, rows: DataFrame) -> DataFrame:
        """The stored rows of the buckets that rows (with bucket) are in: as many numbers as there are buckets at most."""
        numbers = [r[0] for r in rows.select("bucket").distinct().collect()]
        return self.read(table).where(F.col("bucket").isin(numbers))

    def merge_sitemaps(self, rows: DataFrame) -> None:
        """Whole rows of sitemaps in place of those of the same domain; of several for a domain the one with most urls."""
        new = written(rows.withColumn("bucket", self.bucket("sitemaps")), "store-sitemaps")
        if not new.isEmpty():
            self._replace("sitemaps", registry.insert_or_replace(self._touched("sitemaps", new), new, F.struct("url_count", "sitemap_url")))
        discard(new)

    def merge_urls(self, rows: DataFrame, order: Column | str) -> None:
        """The urls of rows that the store lacks, each with its first row in this order."""
        new = written(rows.withColumn("_order", F.col(order) if isinstance(order, str) else order).withColumn("bucket", self.bucket("urls")), "store-urls")
        if not new.isEmpty():
            self._replace("urls", registry.insert_or_ignore(self._touched("urls", new), new, "_order"))
        discard(new)

    def mark_scraped(self, done: DataFrame, now: dt.datetime, batch: int) -> None:
        """Logs the urls of done (url) that the store knows."""
        known = done.select("url").distinct().join(self.read("urls").select("url"), "url", "left_semi")
        known.select("url", F.lit(now).cast("timestamp_ntz").alias("scraped_at")).write.mode("overwrite").parquet(f"{self.path}/scraped/batch={batch}")

    def add(self, domains: DataFrame, captures: DataFrame, now: dt.datetime) -> None:
        """`registry.add_domain` into the store: domains (domain[, sitemap_url]), captured files (url, content)."""
        at = F.lit(now).cast("timestamp_ntz")
        none = [registry.empty(self.spark, s) for s in (registry.SITEMAPS, registry.URLS)]
        settled = lambda df: written(df, "store-fetched")
        sitemaps, urls = registry.add_domain(*none, domains, captures, at, settled)
        sitemaps, urls = written(sitemaps, "store-new"), written(urls, "store-new")
        # the urls first: a sitemap's row tells that they are there
        self.merge_urls(urls, F.lit(0))
        self.merge_sitemaps(sitemaps)
        discard(sitemaps, urls)

    def refresh_stale(self, captures: DataFrame, now: dt.datetime, days: int = registry.STALE_AFTER_DAYS) -> None:
        """Stale domains of which captures (url, content) hold the known sitemap, or any candidate where it is not known."""
        at = F.lit(now).cast("timestamp_ntz")
        known = self.read("sitemaps")
        stale = registry.stale_domains(known, known, at, days).where("stale").join(known.select("domain", "sitemap_url"), "domain")
        tried = stale.where("sitemap_url <> ''").select("domain", "sitemap_url").unionByName(sitemap.candidates(stale.where("sitemap_url = ''")).select("domain", "sitemap_url"))
        here = tried.join(captures.select(F.col("url").alias("sitemap_url")), "sitemap_url", "left_semi").select("domain").distinct()
        due = written(stale.join(here, "domain", "left_semi").select("domain", "sitemap_url"), "store-due")
        if not due.isEmpty():
            self.add(due, captures, now)
        discard(due)


def url_of(path: Column, root: str) -> Column:
    """https:// and a file's path below the folder into which captured files are put as <host>/<path>."""
    return F.concat(F.lit("https://"), F.regexp_replace(path, rf"^.*\Q{root.rstrip('/').rsplit('/', 1)[-1]}\E/", ""))


def refresh_from(store: Store, source: str, checkpoint: str, now: dt.datetime, days: int = registry.STALE_AFTER_DAYS):
    """Refreshes stale domains from the files below source (<host>/<path of the sitemap>) that are new.

    Each batch reads the store again, so a domain that an earlier batch refreshed is
    stale no more. A batch that is run again finds its files already merged. Returns
    when all files at hand are done.
    """

    def batch(df: DataFrame, number: int) -> None:
        files = df.select(url_of(F.col("path"), source).alias("url"), sitemap.unpacked(F.col("path"), F.col("content")).alias("content"))
        store.refresh_stale(files, now, days)

    files = store.spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").schema("path string, modificationTime timestamp, length long, content binary").load(source)
    query = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
