"""Resampling towards a target distribution by importance, in DataFrame operations alone.

Words are lower-cased (A-Z alone) runs of digits, letters and what lies beyond
ASCII; features are a text's words and pairs of neighbouring words, joined by a
space. A feature's bucket is the CRC-32 of its UTF-8 bytes modulo BUCKETS.
Buckets are counted over all documents and over the target texts, pre-aggregated
before the shuffle to BUCKETS rows at most. The table of gains, one row a bucket,
is broadcast; a document's gains are summed beside its own features, which stand
in one task, so its sum leaves that task as one row. With a Gumbel variate from
the document's id added, the highest scores are a weighted draw without
replacement.

Ranks come from a distributed sort: rows are range-partitioned by score and id
and sorted within partitions; a row's rank is its place in its partition after
the rows of all partitions before, of which one row each is summed up. A row's
number breaks the last ties, so alike rows of any number are dealt over
partitions, too.

Defined results: a null text has no words; documents without features have weight
0; a null doc_id is hashed like an empty one and stands behind the others of its
score; repeated rows each have a score (the same) and a rank of their own; very
long texts are rows like any other; with an empty target every gain follows from
smoothing alone; an empty table gives an empty result; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, discard, table, whole_text, written

BUCKETS, SEED, PERCENT, MIN_WORDS = 10_000, 7, 25, 20
#: What stands between words, after lower-casing.
APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words() -> Column:
    return F.array_remove(F.split(ascii_lower(whole_text()), APART), "")


def with_grams(docs: DataFrame) -> DataFrame:
    """docs and n_words, grams: for each word a struct of it and the one behind it, which the last word lacks.

    Pairs are put together after the array is exploded, in generated code: an array of
    ready pairs costs five times as much.
    """
    n = F.size("_words")
    x = docs.withColumn("_words", words())
    behind = F.slice("_words", 2, F.greatest(n - 1, F.lit(0)))
    return x.select(*docs.columns, n.cast("long").alias("n_words"), F.arrays_zip(F.col("_words").alias("word"), behind.alias("next")).alias("grams"))


def bucket(feature: Column, buckets: int = BUCKETS) -> Column:
    return (F.crc32(feature.cast("binary")) % buckets).cast("int")


def gram_buckets(gram: str, buckets: int = BUCKETS) -> tuple[Column, Column]:
    """The buckets of a gram's word and of its pair; null where there is none."""
    word, pair = F.col(f"{gram}.word"), F.concat(F.col(f"{gram}.word"), F.lit(" "), F.col(f"{gram}.next"))
    return bucket(word, buckets), bucket(pair, buckets)


def counts(texts: DataFrame, name: str, buckets: int = BUCKETS) -> DataFrame:
    """bucket, and how many features of the texts it holds."""
    x = with_grams(texts.select("text")).select(F.explode("grams").alias("gram"))
    x = x.select(F.explode(F.array(*gram_buckets("gram", buckets))).alias("bucket")).where("bucket is not null")
    return x.groupBy("bucket").agg(F.count("*").alias(name))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain for every bucket: a thousand times the log ratio of smoothed shares, rounded down."""
    spark = docs.sparkSession
    x = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    x = x.join(counts(docs, "s", buckets), "bucket", "left").join(counts(target, "t", buckets), "bucket", "left").fillna(0, ["s", "t"])
    x = written(x, "importance-counts")  # a row for each bucket
    all_s, all_t = x.agg(F.sum("s"), F.sum("t")).first()
    real = lambda c: c.cast("double")
    ratio = (real(F.col("t") + 1) * F.lit(float(all_s + buckets))) / (real(F.col("s") + 1) * F.lit(float(all_t + buckets)))
    return x.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain"))


def gumbel(seed: int = SEED) -> Column:
    """A thousand Gumbel variates' worth from the id's hash, rounded down."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.left(digest, F.lit(8)), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def scored(docs: DataFrame, gain_table: DataFrame, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """row, doc_id, n_words, n_features, weight, score for every row of docs."""
    own = with_grams(docs.select("doc_id", "text")).withColumn("row", F.monotonically_increasing_id())
    one, two = gram_buckets("gram", buckets)
    each = own.select("row", "doc_id", "n_words", F.explode_outer("grams").alias("gram")).select("row", "doc_id", "n_words", one.alias("one"), two.alias("two"))
    # one row a bucket: the table's size is bounded whatever the input
    for side in ("one", "two"):
        each = each.join(F.broadcast(gain_table.select(F.col("bucket").alias(side), F.col("gain").alias(f"gain_{side}"))), side, "left")
    gain = F.coalesce(F.sum("gain_one"), F.lit(0)) + F.coalesce(F.sum("gain_two"), F.lit(0))
    x = each.groupBy("row", "doc_id", "n_words").agg((F.count("one") + F.count("two")).alias("n_features"), gain.alias("gain"))
    weight = F.when(F.col("n_features") == 0, F.lit(0)).otherwise(F.expr("(gain - pmod(gain, greatest(n_features, 1))) div greatest(n_features, 1)")).cast("long")
    return x.select("row", "doc_id", "n_words", "n_features", weight.alias("weight")).withColumn("score", F.col("weight") + gumbel(seed))


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows and rank (from 1) by a distributed sort in this order, which must tell all rows apart.

    The one window has a row for each partition of the sort.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = written(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_place", place), "importance-sorted")
    sizes = x.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return x.join(F.broadcast(offsets), "_part").withColumn("rank", (F.col("_before") + F.col("_place") + 1).cast("long")).drop("_part", "_place", "_before")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank for every row of docs (doc_id, text):
    of those with min_words words or more, `percent` in a hundred are drawn and have a rank."""
    table_ = gains(docs, target, buckets)
    rows = written(scored(docs, table_, buckets, seed), "importance-scores")
    fit = rows.where(F.col("n_words") >= min_words)
    drawn = fit.count() * percent // 100
    first = ranked(fit, [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")])
    rank = F.when(F.col("rank") <= drawn, F.col("rank"))
    out = first.withColumn("rank", rank).unionByName(rows.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long")))
    return out.select("doc_id", "n_words", "n_features", "weight", "score", "rank")


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' scores for the benchmark's distribution; a quarter of those with 20 words or more is drawn."""
    x = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return x.select("doc_id", "n_features", "weight", "score", "rank")


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of a text's UTF-8 bytes, beside the one row of the table `crc`."""
    data = f"encode({text})"
    code = f"list_transform(range(1, octet_length({data}) + 1), lambda i: CAST('0x' || hex(array_slice({data}, i, i)) AS BIGINT))"
    return f"xor(list_reduce({code}, lambda c, b: xor(c // 256, entries[xor(c % 256, b) + 1]), 4294967295), 4294967295)"


#: The CRC-32 table by its rule: eight divisions of each byte by the reversed polynomial.
CRC_SQL = "crc AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, n)) AS entries)"


def oracle() -> str:
    lowered = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
    WITH {CRC_SQL},
    d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
    w AS (SELECT true AS own, r, doc_id, regexp_extract_all({lowered}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM d
          UNION ALL SELECT false, 0, 0, regexp_extract_all({lowered}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
    f AS (SELECT own, r, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM w),
    b AS (SELECT f, CAST({crc32_sql("f")} % 10000 AS INTEGER) AS b FROM (SELECT DISTINCT f FROM f) AS u, crc),
    c AS (SELECT b, count(*) FILTER (own) AS s, count(*) FILTER (NOT own) AS t FROM f JOIN b USING (f) GROUP BY b),
    a AS (SELECT CAST(sum(s) + 10000 AS DOUBLE) AS s, CAST(sum(t) + 10000 AS DOUBLE) AS t FROM c),
    g AS (SELECT b, CAST(floor(1000.0::DOUBLE * ln((CAST(c.t + 1 AS DOUBLE) * a.s) / (CAST(c.s + 1 AS DOUBLE) * a.t))) AS BIGINT) AS g FROM c, a),
    x AS (SELECT r, count(*) AS n_features, CAST(sum(g) AS BIGINT) AS g FROM f JOIN b USING (f) JOIN g USING (b) WHERE own GROUP BY r),
    h AS (SELECT r, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features,
                 coalesce(CASE WHEN g % n_features < 0 THEN g // n_features - 1 ELSE g // n_features END, 0) AS weight,
                 CAST('0x' || left(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 8) AS BIGINT) AS h FROM w LEFT JOIN x USING (r) WHERE own),
    p AS (SELECT *, CAST(weight + floor(-1000.0::DOUBLE * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM h),
    k AS (SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) END AS k, count(*) FILTER (n_words >= 20) OVER () AS n FROM p)
    SELECT doc_id, n_features, weight, score, CASE WHEN k <= 25 * n // 100 THEN k END AS rank FROM k
    """
