"""Text functions: stripping, truncation, previews, pattern presets, cache keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Pattern presets.
PRESETS = {
    "emails": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "phones": r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b",
    "urls": r"https?://(?:www\.)?[-a-zA-Z0-9@:%._\+~#=]{1,256}\.[a-zA-Z0-9()]{1,6}\b(?:[-a-zA-Z0-9()@:%_\+.~#?&/=]*)",
}
# End of fixed values.


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def truncated(c: Column, most: int | Column, note: str = "Truncated") -> Column:
    """The first `most` code points and a note of the whole length, where longer."""
    head = F.left(c, most if isinstance(most, Column) else F.lit(most))
    return F.when(F.length(c) > most, F.concat(head, F.lit(f"\n\n[{note} - "), F.length(c).cast("string"), F.lit(" total chars]"))).otherwise(c)


def preview(c: Column, lines: int = 10) -> Column:
    """The first lines, and how many more there are."""
    all_lines = F.split(c, "\n")
    head = F.array_join(F.slice(all_lines, 1, lines), "\n")
    more = F.size(all_lines) - lines
    return F.when(more > 0, F.concat(head, F.lit("\n... ("), more.cast("string"), F.lit(" more lines)"))).otherwise(head)


def extract(content: Column, pattern: str) -> Column:
    """Distinct matches, sorted, of a preset's name or a regular expression, in which
    ^ and $ stand at every line. Of an expression with one group, what that matched;
    with more, an array for each match, a group that took no part being ''. Empty for
    null or empty input."""
    expression = PRESETS.get(pattern, pattern)
    if not expression:
        return F.array().cast("array<string>")
    import re

    groups = re.compile(expression).groups
    # multi-line, with the line feed as the one end of a line
    found = lambda i: F.regexp_extract_all(F.coalesce(content, F.lit("")), F.lit(f"(?md){expression}"), F.lit(i))
    if groups < 2:
        return F.array_sort(F.array_distinct(found(groups)))
    each = F.arrays_zip(*[found(i + 1).alias(f"g{i}") for i in range(groups)])
    return F.array_sort(F.array_distinct(F.transform(each, lambda x: F.array(*[x[f"g{i}"] for i in range(groups)]))))


def extract_everything(content: Column) -> Column:
    """All presets, as a struct."""
    return F.struct(*[extract(content, name).alias(name) for name in PRESETS])


def is_paragraphed(content: Column) -> Column:
    """Two blank lines' worth of breaks, or five lines."""
    return (F.regexp_count(content, F.lit("\n\n")) >= 2) | (F.regexp_count(content, F.lit("\n")) >= 5)


def cache_key(query: Column, num_results: Column) -> Column:
    return F.md5(F.concat(F.lower(strip(query)), F.lit(":"), num_results.cast("string")).cast("binary"))


def backoff_delay(failures: Column, base: float = 1.0, cap: float = 30.0) -> Column:
    """Seconds to wait after so many failures in a row."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), failures), F.lit(cap))


def falsy(c: Column) -> Column:
    """null for the empty string."""
    return F.nullif(c, F.lit(""))


def parts_joined(parts: list[Column], separator: str = "\n") -> Column:
    """The parts that are not null, joined."""
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull()), separator)
