"""Threshold-scaled sketches of documents, in DataFrame operations alone.

A text's shingles are the runs of five words (lower-cased A-Z; fewer words: the
whole sequence). Its sketch keeps every distinct shingle hash below a fixed
fraction of the hash range, so a sketch grows with its text, sketches of parts
merge into the sketch of the whole, and containment between very unequal texts
is estimated without bias. A text of which no hash is that low keeps its
smallest one; a merge drops it again as soon as a lower one comes.

The neighbour of a document in id order comes from one shuffle: ids are cut at
approximate quantiles into buckets of near-equal size, each bucket also gets
the first row of the bucket that follows, and a window inside the bucket reads
the next row. There is no global window and no join of texts. Rows without an
id are cut into buckets of their own by the hash of their text, which orders
them. There are up to MOST_BUCKETS buckets and as many again for null ids, each
a sort that spills: at 100 TB one is some 400 MB.

Rows of one id and text that occur more than HEAVY times are counted and stand
as one row: all but one of them are followed by their own text.

Defined results: a null text is empty and has the empty sketch; two empty
sketches are alike (1.0), an empty and another are not (0.0); null ids stand
last; rows of one id, or of none, stand in the order of their texts' hashes; a
single row is its own neighbour; a very long text is one row throughout, its
sketch an eighth of its distinct shingles; an empty table gives an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, ascii_lower, table, whole_text, written
from .op8_mixing import repeated

WORDS = 5
#: A sketch keeps one hash in so many; a power of two from 2 on.
SCALE = 8
ROWS_PER_BUCKET = 2048
MOST_BUCKETS = 2**18
#: Rows of one id and text from which they are counted; there are fewer than rows / HEAVY such pairs.
HEAVY = 100_000
#: Up to so many such pairs are broadcast; more are joined by a shuffle.
BROADCAST_HEAVY = 1_000_000


def shingle_hashes(w: Column, words: int = WORDS) -> Column:
    """Hashes of the runs of so many word hashes; w must be a plain column."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (words - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, words)))


def keep(hashes: Column, scale: int = SCALE) -> Column:
    below = F.lit(2**63 // (scale // 2) if scale > 2 else 2**63 - 1).cast("long")
    return F.array_sort(F.array_distinct(F.filter(hashes, lambda h: (h >= 0) & (h < below))))


def smallest(hashes: Column) -> Column:
    """The smallest hash, read unsigned, as an array of one."""
    flip = F.lit(-(2**63)).cast("long")
    return F.array(F.array_min(F.transform(hashes, lambda h: h.bitwiseXOR(flip))).bitwiseXOR(flip))


def with_sketch(df: DataFrame, text: str, out: str, scale: int = SCALE, words: int = WORDS) -> DataFrame:
    """df and the sketch of a text column; hashes are computed once."""
    h, w = f"_{out}_hashes", f"_{out}_words"
    none = F.array().cast("array<bigint>")
    df = df.withColumn(w, F.transform(F.regexp_extract_all(ascii_lower(F.col(text)), F.lit(WORD), F.lit(0)), lambda x: F.xxhash64(x)))
    df = df.withColumn(h, F.when(F.size(w) > 0, shingle_hashes(F.col(w), words)).otherwise(none))
    df = df.withColumn(out, keep(F.col(h), scale))
    return df.withColumn(out, F.when((F.size(out) == 0) & (F.size(h) > 0), smallest(F.col(h))).otherwise(F.col(out))).drop(h, w)


def merge(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of two parts' shingles together."""
    both = F.array_union(a, b)
    low = keep(both, scale)
    return F.when(F.size(low) > 0, low).when(F.size(both) > 0, smallest(both)).otherwise(both)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity, 0 to 1."""
    common, both = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(1.0)).otherwise(common / both)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has; null where a has none."""
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(a), F.lit(0))


def fingerprint(s: Column) -> Column:
    """The sketch as text: 16 hex digits a hash, ascending."""
    return F.array_join(F.transform(s, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def with_next(df: DataFrame, columns: dict[str, str], rows_per_bucket: int = ROWS_PER_BUCKET, most_buckets: int = MOST_BUCKETS) -> DataFrame:
    """df (doc_id, h, ...) and, under new names, columns of the row that follows
    in descending order of (doc_id, h), nulls last; after the last row, the first."""
    ids = df.select("doc_id", "h")
    size = ids.agg(F.count("*").alias("n"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    n, none_buckets = size["n"], max(1, min(most_buckets, -(-size["nulls"] // rows_per_bucket)))
    # null ids: buckets -1, -2, ..., the larger the hash the nearer to 0; h is uniform
    of_hash = F.floor((F.col("h").cast("double") / 2.0**64 + 0.5) * none_buckets).cast("long")
    of_none = F.greatest(F.lit(-none_buckets), F.least(F.lit(-1), of_hash - none_buckets)).cast("long")
    k = max(1, math.isqrt(min(most_buckets, -(-n // rows_per_bucket)) - 1) + 1) if n else 1
    parts = [i / k for i in range(1, k)]
    # two levels of quantiles: k slices, then k slices of each; at most most_buckets rows of bounds
    first = ids.agg(F.percentile_approx("doc_id", parts, 10_000)).first()[0] if parts else None
    def above(bounds: Column) -> Column:  # how many bounds an id reaches; null ids: -1, below all
        return F.coalesce(F.size(F.filter(bounds, lambda b: b <= F.col("doc_id"))), F.lit(-1))
    outer = above(F.array(*map(F.lit, first or [])).cast("array<bigint>"))
    ids = ids.withColumn("b1", F.when(F.col("doc_id").isNull(), -1).otherwise(outer))
    inner = ids.groupBy("b1").agg((F.percentile_approx("doc_id", parts, 10_000) if parts else F.lit(None)).cast("array<bigint>").alias("bounds"))
    none = F.array().cast("array<bigint>")

    def placed(x: DataFrame) -> DataFrame:
        x = x.withColumn("b1", F.when(F.col("doc_id").isNull(), -1).otherwise(outer))
        x = x.join(F.broadcast(inner), "b1")
        return x.withColumn("bucket", F.when(F.col("doc_id").isNull(), of_none).otherwise(F.col("b1") * k + above(F.coalesce("bounds", none)))).drop("b1", "bounds")

    key = F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", "h")
    heads = placed(df.select("doc_id", "h")).groupBy("bucket").agg(F.max(key).alias("head"))
    line = Window.orderBy(F.desc("bucket"))  # at most 2 * most_buckets rows
    heads = heads.select("bucket", "head", F.coalesce(F.lag("bucket").over(line), F.min("bucket").over(Window.partitionBy())).alias("guest_in"))
    x = placed(df).join(F.broadcast(heads), "bucket")
    # the head of a bucket is also a guest in the bucket before it; of rows alike, the window takes any
    homes = F.when(key == F.col("head"), F.array(F.struct(F.col("bucket").alias("b"), F.lit(False).alias("guest")), F.struct(F.col("guest_in").alias("b"), F.lit(True).alias("guest")))).otherwise(F.array(F.struct(F.col("bucket").alias("b"), F.lit(False).alias("guest"))))
    x = x.withColumn("home", F.explode(homes)).drop("bucket", "head", "guest_in")
    w = Window.partitionBy("home.b").orderBy("home.guest", F.desc_nulls_last("doc_id"), F.desc("h"))
    x = x.select("*", *[F.lead(c).over(w).alias(new) for c, new in columns.items()])
    return x.where(~F.col("home.guest")).drop("home")


def finished(rows: DataFrame, scale: int, words: int, *more: str) -> DataFrame:
    """The result's columns from doc_id, text, own, next_text, next_own; and more ones."""
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left(F.col("text"), n - half), F.left(F.col("next_text"), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "own", "next_own", *more)
    rows = with_sketch(rows, "edited", "changed", scale, words)
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("next_own")).alias("near_next"), *more,
    )


def fingerprints(docs: DataFrame, scale: int = SCALE, words: int = WORDS, heavy: int = HEAVY, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows = docs.select("doc_id", whole_text().alias("text")).withColumn("h", F.xxhash64("text"))
    many = rows.groupBy("doc_id", "h").agg(F.count("*").alias("copies")).where(f"copies > {heavy}")
    many = written(many.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "copies"), "sketch-heavy")
    alike = None
    if not many.isEmpty():
        few = many.limit(BROADCAST_HEAVY + 1).count() <= BROADCAST_HEAVY
        x = rows.join(F.broadcast(many) if few else many, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left").drop("_id", "_h")
        alike = x.where("copies is not null").groupBy("doc_id", "h", "copies").agg(F.first("text").alias("text"))
        rows = x.where("copies is null").drop("copies").unionByName(alike.drop("copies"))
    rows = with_next(with_sketch(rows, "text", "own", scale, words), {"text": "next_text", "own": "next_own"}, rows_per_bucket)
    out = finished(rows, scale, words)
    if alike is None:
        return out
    # all rows of a counted pair but the last are followed by one of their own
    alike = with_sketch(alike.withColumn("copies", F.col("copies") - 1), "text", "own", scale, words)
    alike = alike.withColumn("next_text", F.col("text")).withColumn("next_own", F.col("own"))
    return out.unionByName(repeated(finished(alike, scale, words, "copies"), "copies"))


def op5_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of all documents and of their edited texts, one hash in eight."""
    return fingerprints(table(spark, sf_dir, "documents"))
