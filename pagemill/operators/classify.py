"""Outcome of a retrieval: usable, thin, blocked, empty or encoding-failure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_paragraphed

# What walls say, and titles of walls.
WALLS = (r"verify you are human", r"captcha", r"cloudflare", r"blocked by network security", r"please enable javascript", r"just a moment\.\.\.", r"checking your browser", r"ray id:", r"access denied", r"bot detection")
WALL_TITLES = ("just a moment...", "attention required", "access denied")
# End of fixed values.
WALL_MOST, THIN, VERY_THIN, LONG = 1500, 500, 200, 2000
STATUSES = ("usable", "thin", "blocked", "empty", "encoding-failure")


def lowered(c: Column) -> Column:
    """In lower case, a character for a character as in SQL; lower() alone makes two of the one capital that has a dot above."""
    return F.lower(F.replace(c, F.lit("\u0130"), F.lit("I")))


def outcome(content: Column, title: Column, encoding_error: Column) -> Column:
    """struct(status, confidence, detected_patterns); the first rule that holds decides.

    Null content and titles count as empty, a null encoding_error as false. Patterns are
    distinct and sorted. One CASE over expressions; no Python.
    """
    c, t = F.coalesce(content, F.lit("")), F.coalesce(title, F.lit(""))
    n = F.length(c)
    hits = F.array_sort(F.array_distinct(F.regexp_extract_all(lowered(F.concat(t, F.lit(" "), c)), F.lit("(" + "|".join(WALLS) + ")"), F.lit(1))))

    def is_(status: str, confidence: Column | str, patterns: Column) -> Column:
        confidence = F.lit(confidence) if isinstance(confidence, str) else confidence
        return F.struct(F.lit(status).alias("status"), confidence.alias("confidence"), patterns.alias("detected_patterns"))

    none = F.array().cast("array<string>")
    short = lambda limit: F.when(n < limit, "high").otherwise("medium")
    return (
        F.when(F.coalesce(encoding_error, F.lit(False)), is_("encoding-failure", "high", F.array(F.lit("encoding_error"))))
        .when(n == 0, is_("empty", "high", F.array(F.lit("no_content"))))
        .when((n < WALL_MOST) & (F.size(hits) > 0), is_("blocked", short(THIN), hits))
        .when(lowered(t).isin(*WALL_TITLES), is_("blocked", "high", F.array(F.concat(F.lit("title:"), t))))
        .when(n < THIN, is_("thin", short(VERY_THIN), F.array(F.concat(F.lit("content_length:"), n.cast("string")))))
        .when((n >= LONG) & is_paragraphed(c), is_("usable", "high", none))
        .otherwise(is_("usable", "medium", none))
    )


def with_outcome(df: DataFrame, content: str = "content", title: str | None = "title", encoding_error: str | None = None) -> DataFrame:
    """df and status, confidence, detected_patterns."""
    o = outcome(F.col(content), F.col(title) if title else F.lit(None).cast("string"), F.col(encoding_error) if encoding_error else F.lit(False))
    return df.withColumn("_outcome", o).select(*[F.col(x) for x in df.columns], "_outcome.status", "_outcome.confidence", "_outcome.detected_patterns")


def is_usable(status: Column) -> Column:
    return status == "usable"


def is_blocked(status: Column) -> Column:
    return status == "blocked"


def is_thin(status: Column) -> Column:
    return status == "thin"
