"""URL predicates and parts, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hosts whose pages need a browser (tested as substrings of a host).
JS_HEAVY = ("twitter.com", "x.com", "reddit.com", "youtube.com", "instagram.com", "facebook.com", "linkedin.com", "medium.com", "substack.com", "discord.com")
# Substrings of links that lead to no content.
JUNK = (
    "doubleclick.net", "googlesyndication.com", "googleadservices.com", "facebook.com/plugins", "facebook.com/sharer", "twitter.com/widgets", "twitter.com/intent",
    "linkedin.com/share", "pinterest.com/pin", "/ads/", "/ad/", "/banner/", "/tracker/", "/track/", "analytics", "pixel", "/feed/", "/rss/", "mailto:", "javascript:", "tel:",
)
# Substrings of requests that a renderer drops.
TRACKERS = ("google-analytics", "googletagmanager", "doubleclick", "facebook.com/tr", "facebook.net", "twitter.com/i/adsct")
# End of fixed values.


def any_of(c: Column, words: tuple[str, ...]) -> Column:
    """Whether c holds one of the words; false for null. One compiled pattern."""
    return F.coalesce(c.rlike("|".join(rf"\Q{w}\E" for w in words)), F.lit(False))


def netloc(url: Column) -> Column:
    """Authority with port and user, '' where there is none; tolerates any path."""
    return F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1), F.lit(""))


def with_scheme(url: Column) -> Column:
    """https:// before what does not start with http."""
    return F.when(url.startswith("http"), url).otherwise(F.concat(F.lit("https://"), url))


def host(url: Column) -> Column:
    """Lower-case authority without any www."""
    return F.replace(F.lower(netloc(url)), F.lit("www."), F.lit(""))


def domain(url: Column) -> Column:
    """The registry's domain of a url or a bare name; bare names that start with
    http have none."""
    return host(with_scheme(url))


def is_js_heavy(url: Column) -> Column:
    return any_of(host(url), JS_HEAVY)


def is_junk(url: Column) -> Column:
    return any_of(F.lower(url), JUNK)


def is_tracker(url: Column) -> Column:
    return any_of(url, TRACKERS)


def is_external(link: Column, source: Column) -> Column:
    """Links without a host (mailto:, javascript:) count as external."""
    return host(link) != host(source)


def clean_filename(url: Column, timestamp: Column | None = None) -> Column:
    """host_path with what is no word character taken out; timestamp is text to append."""
    bare = F.replace(netloc(url), F.lit("www."), F.lit(""))
    p = F.replace(F.regexp_replace(path(url), "^/+|/+$", ""), F.lit("/"), F.lit("_"))
    name = F.when(p != "", F.concat(bare, F.lit("_"), p)).otherwise(bare)
    name = F.regexp_replace(F.regexp_replace(name, r"(?U)[^\w\s\-]", ""), r"(?U)[\-\s]+", "_")
    return name if timestamp is None else F.concat(name, F.lit("_"), timestamp)
