"""A registry of sitemaps and their urls: immutable tables and merges of them.

Merges return new tables; the caller writes them (to a new folder or a staging
one) when they are complete. Scraped urls are a log, joined in when asked for.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import domain
from . import sitemap

SITEMAPS = "domain string, sitemap_url string, content_hash string, last_fetched timestamp_ntz, url_count long, status string, error_message string"
URLS = "url string, domain string, last_modified string, priority double, change_frequency string"
SCRAPED = "url string, scraped_at timestamp_ntz"
STALE_AFTER_DAYS = 7


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def first_wins(new: DataFrame, order: Column | str, key: str = "url") -> DataFrame:
    """The first row of each key by an explicit order."""
    order = F.col(order) if isinstance(order, str) else order
    x = new.groupBy(key).agg(F.min_by(F.struct(*new.columns), order).alias("_x"))
    return x.select("_x.*")


def insert_or_ignore(existing: DataFrame, new: DataFrame, order: Column | str, key: str = "url") -> DataFrame:
    """existing and the keys of new that it lacks, each key's first row."""
    add = first_wins(new, order, key).join(existing.select(key), key, "left_anti")
    return existing.unionByName(add.select(*existing.columns))


def insert_or_replace(existing: DataFrame, new: DataFrame, order: Column | str, key: str = "domain") -> DataFrame:
    """existing with whole rows of new in place of those of the same key; of new, each key's last."""
    order = F.col(order) if isinstance(order, str) else order
    last = new.groupBy(key).agg(F.max_by(F.struct(*new.columns), order).alias("_x")).select("_x.*")
    return existing.join(last.select(key), key, "left_anti").select(*existing.columns).unionByName(last.select(*existing.columns))


def failed(domains: DataFrame, now: Column, message: Column) -> DataFrame:
    """Rows of sitemaps for domains that could not be fetched or parsed."""
    return domains.select("domain", F.lit("").alias("sitemap_url"), F.lit("").alias("content_hash"), now.cast("timestamp_ntz").alias("last_fetched"), F.lit(0).cast("long").alias("url_count"), F.lit("failed").alias("status"), message.alias("error_message"))


def process(fetched: DataFrame, children: DataFrame, now: Column, settled: Callable[[DataFrame], DataFrame] = lambda x: x) -> tuple[DataFrame, DataFrame]:
    """(sitemaps, urls) rows to merge from fetched (domain, sitemap_url, content) and
    the captured child sitemaps (url, content). A sitemap without urls is failed."""
    top = fetched.select(F.col("sitemap_url").alias("url"), "content")
    urls = settled(sitemap.expanded(top, children))
    counts = urls.groupBy("sitemap_url").agg(F.count("*").alias("url_count"))
    x = fetched.join(counts, "sitemap_url", "left")
    good = x.where("url_count > 0").select("domain", "sitemap_url", sitemap.content_hash(F.col("content")).alias("content_hash"), now.cast("timestamp_ntz").alias("last_fetched"), "url_count", F.lit("success").alias("status"), F.lit(None).cast("string").alias("error_message"))
    bad = failed(x.where("url_count is null"), now, F.lit("No URLs found in sitemap"))
    return good.unionByName(bad), urls


def add_domain(sitemaps: DataFrame, urls: DataFrame, domains: DataFrame, captures: DataFrame, now: Column, settled: Callable[[DataFrame], DataFrame] = lambda x: x) -> tuple[DataFrame, DataFrame]:
    """The registry's tables after domains (domain[, sitemap_url]) were added.

    Names are normalised; the sitemap is the given one or the first candidate that
    captures (url, content) holds; of several given for a domain, the first by
    name. The first row of a url anywhere stays. Both results read the fetched
    sitemaps and their rows: settled may write these and return what it reads back.
    """
    d = domains.select(domain(F.col("domain")).alias("domain"), (F.nullif("sitemap_url", F.lit("")) if "sitemap_url" in domains.columns else F.lit(None).cast("string")).alias("given"))
    tried = sitemap.candidates(d.where("given is null")).unionByName(d.where("given is not null").select("domain", F.lit(0).alias("pos"), F.col("given").alias("sitemap_url")))
    found = settled(sitemap.first_fetchable(tried.join(captures.select(F.col("url").alias("sitemap_url"), "content"), "sitemap_url")))
    new, rows = process(found, captures, now, settled)
    lost = failed(d.select("domain").join(found.select("domain"), "domain", "left_anti").distinct(), now, F.lit("Could not fetch sitemap"))
    merged = insert_or_replace(sitemaps, new.unionByName(lost), F.struct("url_count", "sitemap_url"))
    return merged, insert_or_ignore(urls, rows.withColumn("_order", F.struct("sitemap_url", "ord")), "_order")


def refresh(sitemaps: DataFrame, urls: DataFrame, domains: DataFrame, captures: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """add_domain again with the known sitemap; failed domains are rediscovered."""
    return add_domain(sitemaps, urls, domains.select("domain").join(sitemaps.select("domain", "sitemap_url"), "domain", "left"), captures, now)


def refresh_stale(sitemaps: DataFrame, urls: DataFrame, captures: DataFrame, now: Column, days: int = STALE_AFTER_DAYS) -> tuple[DataFrame, DataFrame]:
    """The tables after all stale domains were refreshed."""
    return refresh(sitemaps, urls, stale_domains(sitemaps, sitemaps, now, days).where("stale").select("domain"), captures, now)


def with_scraped(urls: DataFrame, scraped_log: DataFrame) -> DataFrame:
    """urls with scraped and scraped_at, the latest of the log; log rows of unknown urls count for nothing."""
    log = scraped_log.groupBy("url").agg(F.max("scraped_at").alias("scraped_at"))
    return urls.join(log, "url", "left").withColumn("scraped", F.col("scraped_at").isNotNull())


def get_urls(urls: DataFrame, domain_name: str, limit: int | None = 100, offset: int = 0, unscraped_only: bool = False) -> DataFrame:
    """A domain's urls, highest priority first, nulls last, then by url. Without a
    limit (None or 0) all of them, and the offset is ignored."""
    x = urls.where(F.col("domain") == domain_name)
    if unscraped_only:
        x = x.where(~F.col("scraped"))
    x = x.orderBy(F.desc_nulls_last("priority"), "url")
    return x.offset(offset).limit(limit) if limit else x


def is_stale(last_fetched: Column, now: Column, days: int = STALE_AFTER_DAYS) -> Column:
    return last_fetched.isNull() | (now.cast("timestamp_ntz") - last_fetched > F.expr(f"interval {days} days"))


def stale_domains(domains: DataFrame, sitemaps: DataFrame, now: Column, days: int = STALE_AFTER_DAYS) -> DataFrame:
    """domain, stale; domains that the registry lacks are stale."""
    return domains.select("domain").join(sitemaps.select("domain", "last_fetched"), "domain", "left").select("domain", is_stale(F.col("last_fetched"), now, days).alias("stale"))


def has_sitemap(sitemaps: DataFrame, domains: DataFrame) -> DataFrame:
    """domain, has_sitemap."""
    good = sitemaps.where("status = 'success'").select("domain").distinct().withColumn("has_sitemap", F.lit(True))
    return domains.select("domain").join(good, "domain", "left").select("domain", F.coalesce("has_sitemap", F.lit(False)).alias("has_sitemap"))


def sitemap_info(sitemaps: DataFrame, domain_name: str) -> DataFrame:
    return sitemaps.where(F.col("domain") == domain_name)


def list_domains(sitemaps: DataFrame) -> DataFrame:
    return sitemaps.select("domain").orderBy("domain")


def stats(sitemaps: DataFrame, urls: DataFrame) -> DataFrame:
    """One row: total_sitemaps, total_urls, scraped_urls, unscraped_urls. urls has scraped."""
    flag = lambda c: c.cast("long")
    s = sitemaps.select(flag(F.col("status") == "success").alias("total_sitemaps"), *[F.lit(0).cast("long").alias(c) for c in ("total_urls", "scraped_urls", "unscraped_urls")])
    u = urls.select(F.lit(0).cast("long").alias("total_sitemaps"), F.lit(1).cast("long").alias("total_urls"), flag(F.col("scraped")).alias("scraped_urls"), flag(~F.col("scraped")).alias("unscraped_urls"))
    return s.unionByName(u).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in s.columns])


def domain_progress(sitemaps: DataFrame, urls: DataFrame) -> DataFrame:
    """domain, url_count, unscraped, scraped: url_count counts repeated urls, so scraped may be too high."""
    left = urls.groupBy("domain").agg(F.count_if(~F.col("scraped")).alias("unscraped"))
    return sitemaps.join(left, "domain", "left").select("domain", "url_count", F.coalesce("unscraped", F.lit(0)).alias("unscraped")).withColumn("scraped", F.col("url_count") - F.col("unscraped"))


def mark_scraped(scraped_log: DataFrame, urls: DataFrame, done: DataFrame, now: Column) -> DataFrame:
    """The log and the urls of done that the registry knows."""
    return scraped_log.unionByName(done.select("url").distinct().join(urls.select("url"), "url", "left_semi").select("url", now.cast("timestamp_ntz").alias("scraped_at")))


def scrape_from_sitemap(sitemaps: DataFrame, urls: DataFrame, scraped_log: DataFrame, pages: DataFrame, domain_name: str, now: dt.datetime, limit: int = 10, unscraped_only: bool = True, captures: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, scraped_log) of a domain's next urls that pages (url, html) holds.

    With captures of sitemaps (url, content), a domain without a sitemap is added and
    a stale one refreshed first.
    """
    from .html import scrape

    if captures is not None:
        at = F.lit(now).cast("timestamp_ntz")
        one = sitemaps.sparkSession.createDataFrame([(domain_name,)], "domain string")
        lacking = has_sitemap(sitemaps, one).where("not has_sitemap").select("domain").union(stale_domains(one, sitemaps, at).where("stale").select("domain")).distinct()
        sitemaps, urls = refresh(sitemaps, urls, lacking, captures, at)
    known = with_scraped(urls, scraped_log)
    top = get_urls(known, domain_name, limit, unscraped_only=unscraped_only).select("url")
    docs = scrape(pages.join(top, "url", "left_semi"))
    return docs, mark_scraped(scraped_log, urls, docs.where("content is not null"), F.lit(now))


def quick_add_domain(sitemaps: DataFrame, urls: DataFrame, captures: DataFrame, name: str, now: dt.datetime) -> tuple[DataFrame, DataFrame]:
    """The registry's tables after one domain was added."""
    one = sitemaps.sparkSession.createDataFrame([(name,)], "domain string")
    return add_domain(sitemaps, urls, one, captures, F.lit(now).cast("timestamp_ntz"))


def quick_get_urls(urls: DataFrame, name: str, limit: int = 100) -> list[str]:
    """A domain's next urls, `limit` at most."""
    return [r["url"] for r in get_urls(urls, name, limit).select("url").collect()]
