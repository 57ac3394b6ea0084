"""Line requests as a stream: one JSON object a line in, one reply a line out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import is_external
from ..operators.discovery import page_links
from ..operators.format import ascii_escaped
from ..operators.captures import latest
from ..operators.research import answered, counts, retrieve, usable_rate
from ..operators.order import placed, running_sum
from ..operators.search import RESEARCH_CAP, capped
from ..tables import hadoop_path, written

# Tools and the names that stand for them.
TOOLS = {"search_sources": "search_sources", "retrieve_source": "retrieve_source", "research_with_sources": "research_with_sources", "extract_urls": "extract_urls", "web_search": "search_sources", "scrape_url": "retrieve_source", "search_and_scrape": "research_with_sources"}
REQUIRED = {"search_sources": "query", "retrieve_source": "url", "research_with_sources": "query", "extract_urls": "url"}
#: (tool, argument, type, default, most, required)
ARGUMENTS = [
    ("search_sources", "query", "string", None, None, True), ("search_sources", "num_results", "integer", "10", 25, False),
    ("retrieve_source", "url", "string", None, None, True), ("retrieve_source", "include_links", "boolean", "false", None, False),
    ("research_with_sources", "query", "string", None, None, True), ("research_with_sources", "limit", "integer", "5", 5, False), ("research_with_sources", "max_content_length", "integer", "5000", None, False),
    ("extract_urls", "url", "string", None, None, True), ("extract_urls", "filter_external", "boolean", "false", None, False),
]
# End of fixed values.
REQUEST = "tool string, args map<string, string>, _broken string"


def schemas(spark: SparkSession) -> DataFrame:
    """tool, properties (argument to type, default, maximum), required: what the tools accept, older names too."""
    x = spark.createDataFrame(ARGUMENTS, "tool string, argument string, type string, default string, maximum int, required boolean")
    x = x.groupBy("tool").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("argument", F.struct("type", "default", "maximum").alias("v"))))).alias("properties"), F.array_sort(F.collect_list(F.when(F.col("required"), F.col("argument")))).alias("required"))
    names = spark.createDataFrame(list(TOOLS.items()), "name string, tool string")
    return names.join(x, "tool").select(F.col("name").alias("tool"), "properties", "required")


def requests(lines: DataFrame) -> DataFrame:
    """lines (value, ...) without blank ones, and tool (resolved), args, error.

    A line that is no JSON object, an unknown tool or a missing argument is an error.
    """
    x = lines.where(F.col("value").rlike(r"(?U)\S"))
    r = F.from_json("value", REQUEST, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    x = x.withColumn("_r", r)
    names = F.create_map(*[F.lit(v) for kv in TOOLS.items() for v in kv])
    needed = F.create_map(*[F.lit(v) for kv in REQUIRED.items() for v in kv])
    x = x.withColumn("tool", F.try_element_at(names, F.col("_r.tool"))).withColumn("args", F.col("_r.args"))
    error = (
        F.when(F.col("_r").isNull() | F.col("_r._broken").isNotNull(), F.lit("Invalid JSON"))
        .when(F.col("tool").isNull(), F.concat(F.lit("Unknown tool: "), F.coalesce(F.col("_r.tool"), F.lit(""))))
        .when(~F.coalesce(F.array_contains(F.map_keys("args"), F.try_element_at(needed, F.col("tool"))), F.lit(False)), F.lit("Missing arguments"))
    )
    return x.withColumn("error", error).drop("_r")


def replies(handled: DataFrame) -> DataFrame:
    """value: {ok, result} or {ok, error} of rows with result (JSON text) and error."""
    good = F.concat(F.lit('{"ok":true,"result":'), F.coalesce("result", F.lit("null")), F.lit("}"))
    bad = F.to_json(F.struct(F.lit(False).alias("ok"), F.col("error")))
    return handled.withColumn("value", ascii_escaped(F.when(F.col("error").isNull(), good).otherwise(bad)))


def tools(results: DataFrame, captures: DataFrame) -> dict[str, Callable[[DataFrame], DataFrame]]:
    """The handlers of the four tools, over search results (query, position, title, url,
    snippet) and captured pages (url, html, ...). Each joins its requests to these
    tables; of a url captured many times the latest capture answers."""
    n = lambda name, default: F.coalesce(F.try_element_at("args", F.lit(name)).try_cast("int"), F.lit(default))
    arg = lambda name: F.try_element_at("args", F.lit(name))
    js = lambda c: F.to_json(c, {"ignoreNullFields": "false"})

    def search_sources(requests: DataFrame) -> DataFrame:
        x = requests.withColumn("query", arg("query")).withColumn("_most", capped(n("num_results", 10)))
        got = x.select("query", "_most").distinct().join(results, "query").where(F.col("position") <= F.col("_most"))
        rows = got.groupBy("query", "_most").agg(F.array_sort(F.collect_list(F.struct("position", "title", "url", "snippet"))).alias("rows"))
        x = x.join(rows, ["query", "_most"], "left")
        return x.withColumn("result", js(F.coalesce("rows", F.array().cast("array<struct<position:int,title:string,url:string,snippet:string>>")))).select(*requests.columns, "result")

    def retrieve_source(requests: DataFrame) -> DataFrame:
        x = requests.withColumn("url", arg("url"))
        page = retrieve(latest(captures.join(x.select("url").distinct(), "url", "left_semi"))).select("url", js(F.struct("url", "title", "content", "signals", "classification")).alias("result"))
        x = x.join(page, "url", "left")
        return x.withColumn("error", F.when(F.col("result").isNull(), F.lit("No capture"))).select(*requests.columns, "result")

    def research_with_sources(requests: DataFrame) -> DataFrame:
        x = requests.withColumn("query", arg("query")).withColumn("_most", capped(n("limit", RESEARCH_CAP), RESEARCH_CAP)).withColumn("_cut", n("max_content_length", 5000))
        asked = x.select("query", "_most", "_cut").distinct()
        serp = asked.join(results, "query").where(F.col("position") <= F.col("_most"))
        rows = answered(serp, captures, F.col("_cut"), ("_most", "_cut"))
        good = F.col("status") == "usable"
        entry = lambda *c: F.struct("position", "url", "title", "snippet", "status", "method", "content_length", *c)
        by = ["query", "_most", "_cut"]
        lists = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.when(good, entry("content")))).alias("sources"), F.array_sort(F.collect_list(F.when(~good, entry("reason")))).alias("failures"), *counts())
        lists = lists.select(*by, "sources", "failures", F.struct("total", "usable_count", usable_rate().alias("usable_rate"), "blocked_count", "thin_count").alias("metrics"))
        none = F.struct(*[F.lit(0).cast("long").alias(c) for c in ("total", "usable_count")], F.lit(0.0).alias("usable_rate"), *[F.lit(0).cast("long").alias(c) for c in ("blocked_count", "thin_count")])
        x = x.join(lists, by, "left")
        empty = lambda c: F.coalesce(c, F.array().cast(lists.schema[c].dataType))
        return x.withColumn("result", js(F.struct("query", empty("sources").alias("sources"), empty("failures").alias("failures"), F.coalesce("metrics", none).alias("metrics")))).select(*requests.columns, "result")

    def extract_urls(requests: DataFrame) -> DataFrame:
        x = requests.withColumn("url", arg("url")).withColumn("_external", F.coalesce(F.lower(arg("filter_external")) == "true", F.lit(False)))
        page = page_links(latest(captures.join(x.select("url").distinct(), "url", "left_semi")))
        x = x.join(page.select("url", "urls"), "url", "left")
        urls = F.coalesce("urls", F.array().cast("array<string>"))
        urls = F.when(F.col("_external"), F.filter(urls, lambda u: is_external(u, F.col("url")))).otherwise(urls)
        return x.withColumn("result", js(F.struct(F.col("url").alias("source_url"), urls.alias("urls"), F.size(urls).alias("count")))).select(*requests.columns, "result")

    return {"search_sources": search_sources, "retrieve_source": retrieve_source, "research_with_sources": research_with_sources, "extract_urls": extract_urls}


def numbered(lines: DataFrame) -> DataFrame:
    """file, line (from 1, blank ones counted), value of lines (value, file, start: where the row's part of its file
    begins) just as a scan gives them: the scan's order within a part, then the parts' order, is that of the file."""
    x = written(placed(lines.withColumn("_n", F.monotonically_increasing_id()), "file", "start", "_n"), "lines")
    return running_sum(x, F.lit(1).cast("long"), "line", ("file",)).select("file", "line", "value")


def answers(lines: DataFrame, handlers: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """file, line, value: one reply for each line (file, line, value) that is not blank."""
    r = written(requests(lines), "requests")
    good = F.col("error").isNull()
    out = r.where(~good).withColumn("result", F.lit(None).cast("string"))
    for tool, handle in handlers.items():
        out = out.unionByName(handle(r.where((F.col("tool") == tool) & good)))
    lost = r.where(~F.coalesce(F.col("tool").isin(*handlers), F.lit(False)) & good)
    out = out.unionByName(lost.withColumn("error", F.lit("No handler")).withColumn("result", F.lit(None).cast("string")))
    return replies(out).select("file", "line", "value")


def serve(spark: SparkSession, source: str, sink: str, checkpoint: str, handlers: dict[str, Callable[[DataFrame], DataFrame]]):
    """Answers the lines of files below source that are new: of a file of requests, the replies stand
    in sink/batch=<n>/file=<its name>, one for each line that is not blank, in their order.

    A handler gets the requests of its tool and returns them, once each, with result.
    A batch is the same files whenever it is run, lines keep their numbers, and a
    batch's folder is overwritten; so after a failure the replies are whole, in order
    and there once. Part files are in the order of their names. The sort deals a
    file's replies over ranges, so a file of any size has many tasks. Files of one
    batch must have different names. Returns when all files at hand are done.
    """

    def batch(df: DataFrame, number: int) -> None:
        out = answers(numbered(df), handlers).withColumn("file", F.element_at(F.split("file", "/"), -1))
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        out = out.repartitionByRange(n, "file", "line").sortWithinPartitions("file", "line")
        out.select("file", "value").write.mode("overwrite").partitionBy("file").text(f"{sink}/batch={number}")

    lines = spark.readStream.text(source).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    query = lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def served(spark: SparkSession, sink: str, batch: int, file: str) -> list[str]:
    """The replies to a file of requests, in order, from the part files that `serve` wrote."""
    fs, p = hadoop_path(spark, f"{sink}/batch={batch}/file={file}")
    parts = sorted(s.getPath().toString() for s in fs.listStatus(p) if s.getPath().getName().startswith("part-"))
    return [r["value"] for part in parts for r in spark.read.text(part).coalesce(1).collect()]
