"""Which capture of a url answers: a url may be captured many times, a question has one answer.

Captures are ordered by fetched_at (microseconds; null is the oldest, and all are
alike without the column), of one time those with html last, then by a hash of the
row. Where a question has a time, the latest capture up to it answers, or the first
one after it where there is none yet, as a page is fetched after it was found;
without a time, the latest answers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import nearest

ORDER = ["at", "there", "capture"]
OLDEST = -(2**63)


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def named(captures: DataFrame) -> DataFrame:
    """captures (url, html[, fetched_at, ...]) and capture: 128 bits that tell its rows apart; at, there."""
    at = F.coalesce(_micros(F.col("fetched_at")), F.lit(OLDEST)) if "fetched_at" in captures.columns else F.lit(0)
    columns = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in captures.columns]
    name = F.concat(F.hex(F.xxhash64(*columns)), F.lit("-"), F.hex(F.xxhash64(F.lit(1), *columns)))
    return captures.withColumn("at", at.cast("long")).withColumn("there", (F.coalesce(F.col("html"), F.lit("")) != "").cast("int")).withColumn("capture", name)


def as_of(asks: DataFrame, own: DataFrame, at: str | None = None) -> DataFrame:
    """asks (url, ...) and `capture` of the one that answers of own (see named); null where the url has none."""
    events = own.select("url", *ORDER)
    if at is None:
        last = events.groupBy("url").agg(F.max(F.struct(*ORDER)).alias("_last"))
        return asks.join(last, "url", "left").select(*asks.columns, F.col("_last.capture").alias("capture"))
    place = lambda t: [t.alias("at"), F.lit(0).alias("there"), F.lit("").alias("capture")]
    # a microsecond behind the question, so that what was fetched at its time counts
    probes = asks.select("url", *place(F.coalesce(_micros(F.col(at)) + 1, F.lit(2**63 - 1))), F.struct(*asks.columns).alias("ask"))
    back = nearest(events, probes, "url", ORDER, ["capture"], forward=False)
    met, early = back.where("found is not null"), back.where("found is null").select(*probes.columns)
    both = met.unionByName(nearest(events, early, "url", ORDER, ["capture"], forward=True))
    return both.select("ask.*", F.col("found.capture").alias("capture"))


def wanted(own: DataFrame, asks: DataFrame) -> DataFrame:
    """The captures that answer any of asks (url, capture), each once."""
    x = own.join(asks.select("url", "capture").where("capture is not null").distinct(), ["url", "capture"], "left_semi")
    return x.dropDuplicates(["url", "capture"])


def latest(captures: DataFrame) -> DataFrame:
    """One capture for each url: the one that answers without a time."""
    x = named(captures).groupBy("url").agg(F.max_by(F.struct(*captures.columns), F.struct(*ORDER)).alias("_x"))
    return x.select("_x.*")


def one_each(rows: DataFrame, key: str = "url") -> DataFrame:
    """One row of rows (url, content, ...) for each url: of several that with the greatest content, null the least."""
    x = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(F.col("content").isNotNull().alias("a"), F.col("content").alias("b"))).alias("_x"))
    return x.select("_x.*")
