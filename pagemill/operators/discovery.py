"""Link discovery: one hop from a list of sources, junk filtered, first seen kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..functions.urls import is_external, is_junk, with_scheme
from .html import parsed
from .registry import first_wins


def filter_junk(links: DataFrame, column: str = "url") -> DataFrame:
    """Rows whose url is no junk."""
    return links.where(~is_junk(F.col(column)))


def page_links(pages: DataFrame, external_only: bool = False) -> DataFrame:
    """url, urls (distinct, sorted, absolute links of the whole page), count."""
    x = parsed(pages.select("url", "html"), "links_all").select("url", F.coalesce("page.links_all", F.array().cast("array<string>")).alias("urls"))
    if external_only:
        x = x.withColumn("urls", F.filter("urls", lambda u: is_external(u, F.col("url"))))
    return x.withColumn("count", F.size("urls"))


def add_sources(sources: DataFrame, new: DataFrame) -> DataFrame:
    """sources (ord, url) and those of new (ord, url) that it lacks, with a scheme, in order after the others."""
    last = sources.agg(F.max("ord")).first()[0]
    add = new.select("ord", with_scheme(strip(F.col("url"))).alias("url"))
    add = first_wins(add, "ord").join(sources.select("url"), "url", "left_anti")
    return sources.select("ord", "url").unionByName(add.select((F.col("ord") + F.lit(0 if last is None else last + 1)).alias("ord"), "url"))


def remove_source(sources: DataFrame, url: str) -> DataFrame:
    """Without the source of exactly this url."""
    return sources.where(F.col("url") != url)


def get_sources(sources: DataFrame) -> DataFrame:
    """url, in the order in which they were added."""
    return sources.orderBy("ord").select("url")


def cleared(discovered: DataFrame) -> tuple[DataFrame, int]:
    """(the empty table, how many rows there were)."""
    return discovered.limit(0), discovered.count()


def discover(sources: DataFrame, pages: DataFrame, discovered: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(new rows of discovered, counters by source).

    sources (ord, url); pages (url, html[, status_code]), of which those with html
    and status 200 count. The first source in order that links a url owns it.
    counters: source, new, junk; junk is counted on each page's distinct links.
    """
    status = F.col("status_code") if "status_code" in pages.columns else F.lit(200)
    fetched = pages.where((F.coalesce(F.col("html"), F.lit("")) != "") & (status == 200)).select("url", "html").join(sources, "url")
    x = parsed(fetched, "links_all", "title").select("ord", F.col("url").alias("source"), F.coalesce(F.nullif(strip(F.col("page.title")), F.lit("")), F.lit("Unknown")).alias("source_title"), F.col("page.links_all").alias("links"))
    links = x.select("ord", "source", "source_title", F.posexplode("links").alias("pos", "url")).withColumn("junk", is_junk(F.col("url")))
    seen = first_wins(links.where("not junk").withColumn("_order", F.struct("ord", "pos")), "_order")
    new = seen.join(discovered.select("url"), "url", "left_anti").select("url", F.col("source").alias("discovered_from"), now.cast("string").alias("timestamp"), "source_title")
    counters = links.groupBy("source").agg(F.count_if("junk").alias("junk")).join(new.groupBy(F.col("discovered_from").alias("source")).agg(F.count("*").alias("new")), "source", "left").select("source", F.coalesce("new", F.lit(0)).alias("new"), "junk")
    return new, counters


def search(discovered: DataFrame, query: str) -> DataFrame:
    """Urls that hold the query, whatever its case; % and _ stand for themselves."""
    return discovered.where(F.contains(F.lower("url"), F.lower(F.lit(query))))


def url_info(discovered: DataFrame, url: str) -> DataFrame:
    return discovered.where(F.col("url") == url)


def stats(sources: DataFrame, discovered: DataFrame) -> DataFrame:
    """One row: total_sources, total_discovered, latest."""
    none = F.lit(None).cast("string")
    x = sources.select(F.lit(1).alias("s"), F.lit(0).alias("d"), none.alias("timestamp")).union(discovered.select(F.lit(0), F.lit(1), "timestamp"))
    return x.agg(F.count_if(F.col("s") == 1).alias("total_sources"), F.count_if(F.col("d") == 1).alias("total_discovered"), F.max("timestamp").alias("latest"))
