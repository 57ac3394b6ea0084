"""Search results: captured result pages, positions, the time-limited cache."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import cache_key
from ..tables import written
from .cache import MAX_ENTRIES, TTL_SECONDS
from .html import APART, first, strings, tree, walk
from .order import placed, running_sum

SERP = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType() if n == "raw_pos" else T.StringType()) for n in ("raw_pos", "title", "href", "snippet")]))
SEARCH_CAP, RESEARCH_CAP = 25, 5


def result_bodies(html: str | None) -> list[dict]:
    """title, href, snippet of each result element; null where a part is missing."""
    if not html:
        return []
    nodes = list(walk(tree(html)))
    has = lambda c: lambda n: c in n.attrs.get("class", "").split()
    out = []
    for i, body in enumerate(n for n in nodes if has("result__body")(n)):
        below = list(walk(body))
        left = {id(n) for n in below if n.name not in APART}
        text = lambda n: None if n is None else "".join(strings(n, left))  # noqa: B023, E731
        a, snippet = first(below, has("result__a")), first(below, has("result__snippet"))
        out.append({"raw_pos": i + 1, "title": text(a), "href": None if a is None else a.attrs.get("href", ""), "snippet": text(snippet)})
    return out


@F.pandas_udf(SERP)
def parse_results(html: pd.Series) -> pd.Series:
    return html.map(result_bodies)


def redirect_target(href: Column) -> Column:
    """The decoded uddg= parameter, or href itself. + stays +, as it is not form data."""
    inner = F.regexp_extract(href, "uddg=([^&]+)", 1)
    return F.when(F.contains(href, F.lit("uddg=")) & (inner != ""), F.coalesce(F.try_url_decode(F.replace(inner, F.lit("+"), F.lit("%2B"))), inner)).otherwise(href)


def positions(raw: DataFrame, num_results: int = 10) -> DataFrame:
    """query, position, title, url, snippet of raw (query, raw_pos, title, href, snippet).

    The first num_results of each query are taken, then those without title or
    http address dropped, then the rest numbered from 1.
    """
    by = Window.partitionBy("query")
    x = raw.withColumn("_n", F.row_number().over(by.orderBy("raw_pos"))).where(F.col("_n") <= num_results)
    x = x.withColumn("url", redirect_target(F.col("href"))).where(F.col("title").isNotNull() & F.coalesce(F.col("url").startswith("http"), F.lit(False)))
    return x.select("query", F.row_number().over(by.orderBy("raw_pos")).alias("position"), "title", "url", F.coalesce("snippet", F.lit("")).alias("snippet"), F.lit("duckduckgo").alias("source"))


def search_sources(serp: DataFrame, query: str, num_results: int = 10, cap: int = SEARCH_CAP) -> DataFrame:
    """A query's results up to num_results (and cap), by position."""
    return serp.where((F.col("query") == query) & (F.col("position") <= min(num_results, cap))).orderBy("position")


def search_urls(serp: DataFrame, query: str, num_results: int = 10) -> DataFrame:
    return search_sources(serp, query, num_results).select("url")


def from_library(rows: DataFrame) -> DataFrame:
    """query, position, title, url, snippet of (query, ord, title, href, link, body, snippet). Positions are
    counted over slices, so a query may have any share of the rows."""
    x = running_sum(written(placed(rows, "query", "ord", place="_place"), "library"), F.lit(1).cast("long"), "_nth", ("query",), "_place")
    either = lambda a, b: F.coalesce(F.nullif(a, F.lit("")), F.col(b), F.lit(""))
    return x.select("query", F.col("_nth").cast("int").alias("position"), "title", either("href", "link").alias("url"), either("body", "snippet").alias("snippet"))


def first_source(queries: DataFrame, sources: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(results, failures) of queries (query): the rows of the first source, in their order,
    that has any for the query, and `answered_by`; (query, error) of queries without any."""
    parts = [x.withColumn("answered_by", F.lit(name)).withColumn("_rank", F.lit(i)) for i, (name, x) in enumerate(sources.items())]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).join(queries.select("query").distinct(), "query", "left_semi")
    best = every.groupBy("query").agg(F.min("_rank").alias("_rank"))
    failed = queries.select("query").distinct().join(best, "query", "left_anti").withColumn("error", F.lit("All search methods failed"))
    return every.join(best, ["query", "_rank"]).drop("_rank"), failed


def capped(n: Column, cap: int = SEARCH_CAP) -> Column:
    """How many results a request gets; research takes RESEARCH_CAP at most."""
    return F.least(n, F.lit(cap))


def cleared(entries: DataFrame) -> tuple[DataFrame, int]:
    """(the empty cache, how many entries there were)."""
    return entries.limit(0), entries.count()


def lookup(entries: DataFrame, requests: DataFrame, ttl: int = TTL_SECONDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """requests (query, num_results, ts, and the columns of keep) and hit: whether entries (query, num_results,
    ts, success) hold a successful one of the same key, made at most ttl seconds before
    (exclusive). An as-of join: the latest entry up to the request, by one window over
    both. Entries are given here, each request's answer apart; `cache.replay` has
    the requests themselves make the entries. What counts is at most ttl old, so a key's line is cut into slices of ttl
    seconds; a slice also gets the latest entry of the one before, and a key with very
    many requests is dealt over as many tasks as it has slices."""
    key = cache_key(F.col("query"), F.col("num_results"))
    at = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    slice_ = F.floor(at("ts") / F.lit(ttl * 1_000_000)).alias("slice")
    none = [F.lit(None).cast(requests.schema[c].dataType).alias(c) for c in keep]
    e = entries.where("success").select(key.alias("key"), slice_, F.lit(None).cast("string").alias("query"), F.lit(None).cast("int").alias("num_results"), "ts", F.lit(0).alias("side"), *none)
    before = e.groupBy("key", "slice").agg(F.max("ts").alias("ts")).select("key", (F.col("slice") + 1).alias("slice"), F.lit(None).cast("string").alias("query"), F.lit(None).cast("int").alias("num_results"), "ts", F.lit(0).alias("side"), *none)
    r = requests.select(key.alias("key"), slice_, "query", F.col("num_results").cast("int").alias("num_results"), "ts", F.lit(1).alias("side"), *keep)
    w = Window.partitionBy("key", "slice").orderBy("ts", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = e.unionByName(before).unionByName(r).withColumn("made", F.last(F.when(F.col("side") == 0, F.col("ts")), ignorenulls=True).over(w)).where("side = 1")
    return x.select("query", "num_results", "ts", *keep, F.coalesce(at("ts") - at("made") < ttl * 1_000_000, F.lit(False)).alias("hit"))


def evicted(entries: DataFrame, max_size: int = MAX_ENTRIES) -> DataFrame:
    """The max_size latest entries (key, ts, ...)."""
    return entries.orderBy(F.desc("ts"), "key").limit(max_size)


def cache_stats(entries: DataFrame, max_size: int = MAX_ENTRIES, ttl: int = TTL_SECONDS) -> DataFrame:
    return entries.agg(F.count("*").alias("size")).select("size", F.lit(max_size).alias("max_size"), F.lit(ttl).alias("ttl_seconds"))
