"""Retrieval records, routing between captures, and research over search results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import falsy, truncated
from ..functions.urls import is_js_heavy
from . import captures as cp
from .classify import outcome
from .html import scrape

MIN_CONTENT, PREVIEW = 200, 200


def route(url: Column, static_content: Column, force: str | None = None, min_content: int = MIN_CONTENT) -> Column:
    """'static', 'javascript' or 'fallback_javascript' (static text too short)."""
    if force == "js":
        return F.lit("javascript")
    short = F.length(F.coalesce(static_content, F.lit(""))) < min_content
    heavy = F.lit(False) if force == "static" else is_js_heavy(url)
    return F.when(heavy, "javascript").when(short, "fallback_javascript").otherwise("static")


def routed(static: DataFrame, rendered: DataFrame, force: str | None = None, min_content: int = MIN_CONTENT) -> DataFrame:
    """The scraped columns of static (see scrape) or, where the route asks for it,
    of rendered, by url; and route. Only rows so routed meet rendered, of which each url has one row."""
    rendered = cp.one_each(rendered)
    x = static.withColumn("route", route(F.col("url"), F.col("content"), force, min_content))
    other = x.where("route <> 'static'").select("url", "route").join(rendered, "url", "left")
    return x.where("route = 'static'").unionByName(other, allowMissingColumns=True)


def compare_methods(static: DataFrame, rendered: DataFrame) -> DataFrame:
    """url, success, length and preview of both methods, and the recommended one; each url once."""
    def side(df: DataFrame, p: str) -> DataFrame:
        c = F.coalesce("content", F.lit(""))
        return df.select("url", (c != "").alias(f"{p}_success"), F.length(c).alias(f"{p}_length"), F.left(c, F.lit(PREVIEW)).alias(f"{p}_preview"))

    x = side(cp.one_each(static), "static").join(side(cp.one_each(rendered), "js"), "url")
    return x.withColumn("recommended", F.when(F.col("static_success") & (F.col("static_length") > MIN_CONTENT), "static").otherwise("javascript"))


def with_signals(scraped: DataFrame, method: str = "static", encoding_error: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """url, title, content, metadata, signals, classification of scraped rows, and the columns of keep."""
    error = F.lit(False) if encoding_error is None else F.coalesce(encoding_error, F.lit(False))
    c = F.coalesce("content", F.lit(""))
    signals = F.struct(F.length(c).alias("content_length"), F.lit(method).alias("method"), F.lit(True).alias("had_html"), error.alias("encoding_error"))
    return scraped.select("url", "title", "content", "metadata", signals.alias("signals"), outcome(F.col("content"), F.col("title"), error).alias("classification"), *keep)


def retrieve(captures: DataFrame, method: str = "static", keep: tuple[str, ...] = (), text: Callable[[Column], Column] | None = None) -> DataFrame:
    """Captured pages (url, html[, status_code, encoding_error]) as retrieval records, one for each row. text: see scrape."""
    flags = tuple(c for c in ("encoding_error",) if c in captures.columns)
    scraped = scrape(captures, ("clean_text", "metadata"), method, keep=flags + keep, text=text)
    return with_signals(scraped, method, F.col("encoding_error") if flags else None, keep)


def answered(serp: DataFrame, captures: DataFrame, max_content_length: int | Column = 5000, keep: tuple[str, ...] = (), at: str | None = None, method: str = "static", text: Callable[[Column], Column] | None = None) -> DataFrame:
    """`joined` rows of search results with the one capture that answers each (see captures): the latest
    up to the result's time in the column `at`, or of all. Only captures that answer are parsed, each once."""
    own = cp.named(captures)
    asks = cp.as_of(serp.where(F.coalesce(F.col("url"), F.lit("")) != ""), own, at)
    return joined(asks, retrieve(cp.wanted(own, asks), method, keep=("capture",), text=text), max_content_length, keep)


def to_dict(scraped: DataFrame, include_links: bool = False) -> DataFrame:
    """url, title, content, metadata, links; links are null unless asked for."""
    links = F.col("links") if include_links else F.lit(None).cast("array<string>")
    return scraped.select("url", "title", "content", "metadata", links.alias("links"))


def server_replies(scraped: DataFrame, pooled: bool = False, include_links: bool = False) -> DataFrame:
    """What the server adds to a scraped document: success, content_length, browser_pooled;
    a page without html is a failure with an error."""
    there = F.col("status_code") != 0
    x = to_dict(scraped, include_links).columns
    links = F.col("links") if include_links else F.lit(None).cast("array<string>")
    fields = [links.alias("links") if c == "links" else F.col(c) for c in x]
    return scraped.select(*fields, there.alias("success"), F.length(F.coalesce("content", F.lit(""))).alias("content_length"), F.lit(pooled).alias("browser_pooled"), F.when(~there, F.lit("Could not fetch page")).alias("error"))


def joined(serp: DataFrame, retrieved: DataFrame, max_content_length: int | Column = 5000, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each search result with a url: the retrieval's fields, the title of the
    page or else of the result, the content cut at max_content_length, and a reason
    where the page is not usable; and the result's columns of keep. Results without a
    retrieval are errors. Where both sides name a capture, they meet by it; otherwise
    one retrieval of each url counts."""
    s = serp.where(F.coalesce(F.col("url"), F.lit("")) != "")
    by_capture = "capture" in serp.columns and "capture" in retrieved.columns
    r = retrieved if by_capture else cp.one_each(retrieved)
    r = r.select(F.col("url").alias("_url"), *([F.col("capture").alias("_capture")] if by_capture else []), F.col("title").alias("_title"), "content", "signals", "classification")
    same = F.col("url") == F.col("_url")
    x = s.join(r, same & (F.col("capture") == F.col("_capture")) if by_capture else same, "left")
    status = F.coalesce("classification.status", F.lit("error"))
    usable = status == "usable"
    reason = F.when(status == "error", F.array(F.lit("not retrieved"))).when(~usable, F.col("classification.detected_patterns"))
    return x.select(
        "query", "position", "url", F.coalesce(falsy(F.col("_title")), F.col("title")).alias("title"), "snippet", status.alias("status"),
        F.col("signals.method").alias("method"), F.col("signals.content_length").alias("content_length"), F.when(usable, truncated(F.col("content"), max_content_length)).alias("content"), reason.alias("reason"), *keep,
    )


def sources(rows: DataFrame) -> DataFrame:
    return rows.where("status = 'usable'").drop("reason")


def failures(rows: DataFrame) -> DataFrame:
    return rows.where("status <> 'usable'").drop("content")


def counts() -> list[Column]:
    """total, usable_count, blocked_count, thin_count over rows of a query."""
    is_ = lambda s: F.count_if(F.col("status") == s)
    return [F.count("*").alias("total"), is_("usable").alias("usable_count"), is_("blocked").alias("blocked_count"), is_("thin").alias("thin_count")]


def usable_rate() -> Column:
    return F.when(F.col("total") == 0, F.lit(0.0)).otherwise(F.bround(F.col("usable_count") / F.nullif(F.col("total"), F.lit(0)), 2))


def metrics(rows: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """query, total, usable_count, usable_rate, blocked_count, thin_count. Queries
    without results (a failed search) have zeros. Other outcomes count in total alone."""
    m = rows.groupBy("query").agg(*counts())
    if queries is not None:
        m = queries.select("query").distinct().join(m, "query", "left").fillna(0, ["total", "usable_count", "blocked_count", "thin_count"])
    return m.select("query", "total", "usable_count", usable_rate().alias("usable_rate"), "blocked_count", "thin_count")


def search_errors(queries: DataFrame, failed: DataFrame) -> DataFrame:
    """query, search_error: what failed (query, error) says of a query, null where its search went well."""
    e = failed.groupBy("query").agg(F.min(F.coalesce("error", F.lit("Search failed"))).alias("search_error"))
    return queries.select("query").distinct().join(e, "query", "left")


def search_and_scrape(serp: DataFrame, retrieved: DataFrame, max_content_length: int = 5000, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every search result with its content, scraped_successfully and an error, and its columns of keep; no outcome. One
    retrieval of each url counts."""
    r = cp.one_each(retrieved).select("url", "content", "signals")
    x = serp.join(r, "url", "left")
    good = F.coalesce("content", F.lit("")) != ""
    return x.select("query", "position", "url", "title", "snippet", F.when(good, truncated(F.col("content"), max_content_length)).alias("content"), F.length(F.when(good, F.col("content"))).alias("content_length"), good.alias("scraped_successfully"), F.when(~good, F.lit("no content")).alias("error"), *keep)
