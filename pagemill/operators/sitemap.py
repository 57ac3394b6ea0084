"""Sitemap XML to rows."""

from __future__ import annotations

import gzip
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip
from ..functions.urls import domain
from ..tables import written
from .order import placed, running_sum

NAMESPACE = "{http://www.sitemaps.org/schemas/sitemap/0.9}"
ENTRIES = T.ArrayType(T.StructType([T.StructField(n, T.DoubleType() if n == "priority" else T.StringType()) for n in ("kind", "url", "last_modified", "priority", "change_frequency")]))
# Where sites keep their sitemap, in order of trial.
CANDIDATES = ("https://{}/sitemap.xml", "https://{}/sitemap_index.xml", "https://{}/sitemap-index.xml", "https://{}/sitemap1.xml", "https://{}/post-sitemap.xml", "https://{}/page-sitemap.xml", "https://www.{}/sitemap.xml")
# End of fixed values.


def candidates(domains: DataFrame, column: str = "domain") -> DataFrame:
    """domain, pos (from 0), sitemap_url."""
    urls = [F.concat(F.lit(a), F.col(column), F.lit(b)) for a, b in (c.split("{}") for c in CANDIDATES)]
    return domains.select(F.col(column).alias("domain"), F.posexplode(F.array(*urls)).alias("pos", "sitemap_url"))


def first_fetchable(found: DataFrame) -> DataFrame:
    """Of (domain, pos, sitemap_url, content), each domain's first with content, whether it parses or not."""
    x = found.where("content is not null")
    return x.groupBy("domain").agg(F.min_by(F.struct("sitemap_url", "content"), F.struct("pos", "sitemap_url")).alias("x")).select("domain", "x.*")


def _text(node: ET.Element, name: str) -> str | None:
    return next((t for tag in (NAMESPACE + name, name) if (t := (node.findtext(tag) or "").strip())), None)


def entries(content: bytes | None) -> list[dict]:
    """Entries of kind 'sitemap' for an index, of kind 'url' otherwise; none for bad
    XML. A priority that is no number raises ValueError."""
    if not content:
        return []
    try:
        root = ET.fromstring(bytes(content))
    except ET.ParseError:
        return []
    below = lambda name: [n for n in root.iter(NAMESPACE + name) if n is not root] or [n for n in root.iter(name) if n is not root]
    if children := below("sitemap"):
        return [{"kind": "sitemap", "url": u, "last_modified": None, "priority": None, "change_frequency": None} for n in children if (u := _text(n, "loc"))]
    out = []
    for n in below("url"):
        if url := _text(n, "loc"):
            p = _text(n, "priority")
            out.append({"kind": "url", "url": url, "last_modified": _text(n, "lastmod"), "priority": float(p) if p else None, "change_frequency": _text(n, "changefreq")})
    return out


@F.pandas_udf(ENTRIES)
def parse_sitemap(content: pd.Series) -> pd.Series:
    return content.map(entries)


@F.pandas_udf(T.BinaryType())
def _gunzip(content: pd.Series) -> pd.Series:
    return content.map(lambda b: None if b is None else gzip.decompress(bytes(b)))


def unpacked(url: Column, content: Column) -> Column:
    """Content, unzipped where the url ends in .gz; broken data raises."""
    return F.when(url.endswith(".gz"), _gunzip(F.when(url.endswith(".gz"), content))).otherwise(content)


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def read_files(spark, path: str) -> DataFrame:
    """url (the file's path), content, fetched_at of the files below a folder."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return x.select(F.col("path").alias("url"), unpacked(F.col("path"), F.col("content")).alias("content"), F.col("modificationTime").cast("timestamp_ntz").alias("fetched_at"))


def parsed(sitemaps: DataFrame) -> DataFrame:
    """sitemap_url, domain, ord, kind, url, ... a row for each entry of (url, content)."""
    x = sitemaps.select(F.col("url").alias("sitemap_url"), F.posexplode(parse_sitemap("content")).alias("ord", "e"))
    return x.select("sitemap_url", domain(F.col("sitemap_url")).alias("domain"), "ord", "e.*")


def expanded(sitemaps: DataFrame, fetched: DataFrame) -> DataFrame:
    """Url rows of sitemaps (url, content), those of an index from its children in
    fetched (url, content), one level deep. ord is (place in the index, place in the sitemap)."""
    top = parsed(sitemaps)
    own = top.where("kind = 'url'").select("sitemap_url", "domain", F.struct(F.lit(0).alias("child"), "ord").alias("ord"), "url", "last_modified", "priority", "change_frequency")
    child = top.where("kind = 'sitemap'").select(F.col("sitemap_url").alias("parent"), F.col("ord").alias("child"), F.col("url").alias("child_url"))
    below = child.join(parsed(fetched.join(child.select(F.col("child_url").alias("url")).distinct(), "url", "left_semi")).where("kind = 'url'"), F.col("child_url") == F.col("sitemap_url"))
    below = below.select(F.col("parent").alias("sitemap_url"), "domain", F.struct("child", "ord").alias("ord"), "url", "last_modified", "priority", "change_frequency")
    return own.unionByName(below)


#: Files larger than this are read in parts.
LARGE = 64 << 20
URL = "loc string, lastmod string, priority string, changefreq string, _broken string"


def read_parts(spark, paths: list[str]) -> DataFrame:
    """sitemap_url (the file's path), ord, kind, url, ... of plain urlset files, as `parsed` has them, from parts of
    files that different tasks read: a record ends at </url>, and Spark's own XML expression reads each.

    One file's rows are those of `entries` if its records are well-formed and only
    urlset's own tags stand around them; a file with anything else (an index,
    prefixes, a broken end) is parsed whole instead. Packed files can't be split.
    """
    head, end = r"(?s)^.*?<url(?:\s[^>]*)?>", "</url>"
    lines = spark.read.option("lineSep", end).text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    x = written(placed(lines.withColumn("_n", F.monotonically_increasing_id()), "file", "start", "_n"), "sitemap-parts")
    x = running_sum(x, F.lit(1).cast("long"), "line", ("file",))
    inner, before = F.regexp_replace("value", head, ""), F.regexp_extract("value", head, 0)
    body = F.from_xml(F.concat(F.lit("<url>"), inner, F.lit(end)), URL, {"rowTag": "url", "columnNameOfCorruptRecord": "_broken", "mode": "PERMISSIVE"})
    x = x.select("file", "line", F.col("value").rlike(head).alias("record"), before.alias("before"), inner.alias("inner"), "value").withColumn("e", F.when(F.col("record"), body))
    # what may stand before the first record, between records, and after the last
    opening = r"(?s)^\ufeff?\s*(<\?xml[^>]*\?>\s*)?(<!--.*?-->\s*)*<urlset(\s[^>]*)?>\s*<url(?:\s[^>]*)?>$"
    fits = F.when(F.col("record"), F.col("e._broken").isNull() & ~F.contains("inner", F.lit("<url>")) & F.when(F.col("line") == 1, F.col("before").rlike(opening)).otherwise(F.col("before").rlike(r"^\s*<url(?:\s[^>]*)?>$"))).otherwise((F.col("line") > 1) & F.col("value").rlike(r"^\s*</urlset>\s*$"))
    x = written(x.withColumn("fits", F.coalesce(fits, F.lit(False))), "sitemap-records")
    # a whole file has one closing record, the last
    shape = x.groupBy("file").agg(F.min("fits").alias("fits"), F.count_if(~F.col("record")).alias("ends"), F.max(F.when(~F.col("record"), F.col("line"))).alias("end"), F.max("line").alias("last"))
    plain = (F.col("fits") & (F.col("ends") == 1) & (F.col("end") == F.col("last")))
    odd = [r["file"] for r in shape.where(~plain).select("file").collect()]
    none = lambda c: F.nullif(strip(F.col(f"e.{c}")), F.lit(""))
    rows = x.join(shape.where(plain).select("file"), "file", "left_semi").where("record").where(none("loc").isNotNull())
    rows = rows.select(F.col("file").alias("sitemap_url"), domain(F.col("file")).alias("domain"), (F.col("line") - 1).cast("int").alias("ord"), F.lit("url").alias("kind"), none("loc").alias("url"), none("lastmod").alias("last_modified"), none("priority").cast("double").alias("priority"), none("changefreq").alias("change_frequency"))
    if not odd:
        return rows
    whole = spark.read.format("binaryFile").load(odd).select(F.col("path").alias("url"), "content")
    return rows.unionByName(parsed(whole))


def read_sitemaps(spark, path: str, large: int = LARGE) -> DataFrame:
    """Rows of all sitemap files below a folder: files of more than `large` bytes by `read_parts`, others by `parsed`.
    ord is increasing in each file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length").collect()
    big = [r["path"] for r in files if r["length"] > large and not r["path"].endswith(".gz")]
    small = [r["path"] for r in files if r["path"] not in set(big)]
    out = [read_parts(spark, big)] if big else []
    if small:
        x = spark.read.format("binaryFile").load(small)
        out.append(parsed(x.select(F.col("path").alias("url"), unpacked(F.col("path"), F.col("content")).alias("content"))))
    return out[0] if len(out) == 1 else out[0].unionByName(out[1]) if out else parsed(spark.createDataFrame([], "url string, content binary"))
