"""Documents as text for readers and models, and file sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import falsy, parts_joined, truncated
from ..tables import written
from .order import placed, running_sum


def _part(c: Column, *, before: str = "", after: str = "") -> Column:
    return F.concat(F.lit(before), falsy(c), F.lit(after))


def markdown(title: Column, content: Column, description: Column, author: Column, published: Column) -> Column:
    """Title, quoted description, author and date, then the content; empty parts left out."""
    gap = F.when(F.coalesce(falsy(author), falsy(published)).isNotNull(), F.lit(""))
    return parts_joined([_part(title, before="# ", after="\n"), _part(description, before="> ", after="\n"), _part(author, before="**Author:** "), _part(published, before="**Published:** "), gap, falsy(content)])


def for_llm(title: Column, content: Column, description: Column) -> Column:
    return parts_joined([_part(title, before="# ", after="\n"), _part(description, before="*", after="*\n"), falsy(content)])


def article(title: Column, content: Column) -> Column:
    return parts_joined([_part(title, before="Title: "), _part(content, before="\nContent:\n")])


def summary(text: Column, max_length: int = 5000) -> Column:
    """Text cut at max_length, with a note of the whole length."""
    return truncated(text, max_length, "Content truncated")


def ascii_escaped(json: Column) -> Column:
    """JSON text in which what lies beyond printable ASCII is escaped, by pairs above U+FFFF."""
    code = lambda c: F.lower(F.hex(F.encode(c, "UTF-16BE")))
    escaped = lambda c: F.when(F.octet_length(c) < 4, F.concat(F.lit("\\u"), code(c))).otherwise(F.concat(F.lit("\\u"), F.left(code(c), F.lit(4)), F.lit("\\u"), F.right(code(c), F.lit(4))))
    one = lambda c: F.when(c.rlike(r"^[\x20-\x7E]?$"), c).otherwise(escaped(c))
    return F.when(json.rlike(r"[^\x20-\x7E]"), F.array_join(F.transform(F.split(json, ""), one), "")).otherwise(json)


def as_json(df: DataFrame, ascii_only: bool = False) -> DataFrame:
    """One column `value`, a JSON object for each row with its nulls; ascii_only escapes what lies beyond ASCII."""
    x = F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false"})
    return df.select((ascii_escaped(x) if ascii_only else x).alias("value"))


def iso(ts: Column) -> Column:
    """A time in ISO 8601, with microseconds where there are any; null for null."""
    micro = F.date_format(ts, "SSSSSS")
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micro != "000000", F.concat(F.lit("."), micro)).otherwise(""))


def as_records(df: DataFrame) -> DataFrame:
    """df with its times as ISO text, as JSON records have them."""
    return df.select(*[iso(F.col(f.name)).alias(f.name) if f.dataType.typeName().startswith("timestamp") else F.col(f.name) for f in df.schema])


def search_responses(queries: DataFrame, results: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """query, response: a struct(query, results, total_results, source, success, error, cached) for each of
    queries (query[, cached]), with its results (query, position, title, url, snippet, source) nested in
    their order; a query of failed (query, error) has none."""
    own = results.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("position", "title", "url", "snippet", "source"))).alias("results"))
    x = queries.join(own, "query", "left")
    x = x.join(failed.select("query", "error"), "query", "left") if failed is not None else x.withColumn("error", F.lit(None).cast("string"))
    cached = F.col("cached") if "cached" in queries.columns else F.lit(False)
    rows = F.when(F.col("error").isNull() & F.col("results").isNotNull(), F.col("results")).otherwise(F.array().cast(own.schema["results"].dataType))
    good = F.col("error").isNull()
    return x.select("query", F.struct("query", rows.alias("results"), F.size(rows).alias("total_results"), F.lit("duckduckgo").alias("source"), good.alias("success"), "error", cached.alias("cached")).alias("response"))


def batch_files(docs: DataFrame, name: Column) -> tuple[DataFrame, DataFrame]:
    """(file, text of the documents (ord, url, text) with a text; one row: success_count, total).
    ord counts from 0; files are numbered from 1 by it."""
    good = F.coalesce(F.col("text"), F.lit("")) != ""
    number = F.lpad((F.col("ord") + 1).cast("string"), 3, "0")
    number = F.when(F.col("ord") < 999, number).otherwise((F.col("ord") + 1).cast("string"))
    files = docs.where(good).select(F.concat(number, F.lit("_"), name, F.lit(".md")).alias("file"), "text")
    return files, docs.agg(F.count_if(good).alias("success_count"), F.count("*").alias("total"))


def unique_names(files: DataFrame, order: str, name: str = "name", extension: str = ".md") -> DataFrame:
    """files and `file`: of equal names the first keeps its name, the others get _1, _2, ... in order.
    Names are counted over slices, so one name may be that of any share of the files."""
    x = written(placed(files, name, order, place="_place"), "names")
    x = running_sum(x, F.lit(1).cast("long"), "_nth", (name,), "_place")
    at = F.col("_nth") - 1
    return x.select(*files.columns, F.concat(F.col(name), F.when(at > 0, F.concat(F.lit("_"), at.cast("string"))).otherwise(""), F.lit(extension)).alias("file"))


def write_text_files(df: DataFrame, key: str, text: str, path: str) -> None:
    """A folder for each key with the texts in it; refuses to write over what is there."""
    df.select(F.col(key), F.col(text).alias("value")).write.mode("errorifexists").partitionBy(key).text(path)
