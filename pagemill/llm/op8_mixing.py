"""Mixing sources to target weights, in DataFrame operations alone.

Every document gets a hash-random key. Within its source, documents stand on a
line in key order, each as long as its words; the line is cut at the source's
exact budget, and a budget above the source's size repeats whole epochs first.

The line is range-sorted in slices: a source of n documents has a slice of the
key's range for every SLICE documents, so that slices hold near-equal numbers
whatever the ids are and a source with a third of all rows has a third of all
slices. Sums by slice are pre-aggregated before the shuffle; prefix sums over
blocks of slices, then over the slices of a block, place each slice on the
line; and only the slice that holds a source's cut is sorted row by row. The
result of that is one row for each source (its epochs, its cut key, what is
taken there), against which every document is compared where it stands: no text
and no row of a source is gathered anywhere.

Rows of one source, key, id and size are alike and are counted, not sorted, so
a group of repeated rows of any size is one row of its slice.

Defined results: a null text has size 0; null sources form one source, the last;
null ids and repeated rows keep their rows; a source without words gets target 0;
very long texts are single documents, of which the cut takes a part; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, discard, table, whole_text, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_EPOCHS = 2
#: Documents of a slice, slices of a block, copies that one row is exploded to.
SLICE, BLOCK, CHUNK = 1024, 1024, 4096
#: Up to so many rows, one for each source, are broadcast.
BROADCAST_SOURCES = 100_000
BY = ["no_source", "source"]


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """no_source, source, source_size, target, budget from no_source, source, source_size.

    One narrow row per source, so its windows see no documents. With level l, a
    target is min(most * size, l * weight); sources reach their cap in the order
    of cap / weight, and l is the level at the first one that does not.
    """
    order = Window.orderBy("no_source", "source")
    line = Window.orderBy("r", "no_source", "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    x = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most).withColumn("r", F.col("cap") / F.col("weight"))
    all_size, all_weight = F.sum("source_size").over(Window.partitionBy()), F.sum("weight").over(Window.partitionBy())
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("level", (share * all_size - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (all_weight - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    x = x.withColumn("at", F.row_number().over(line)).withColumn("open", F.when(F.col("r") > F.col("level"), F.struct("at", "level")))
    level = F.min("open").over(Window.partitionBy()).getField("level")
    x = x.withColumn("target", F.coalesce(F.least(F.col("cap").cast("double"), level * F.col("weight")), F.col("cap").cast("double")))
    return x.select("no_source", "source", "source_size", "target", F.floor(F.col("target") + 0.5).cast("long").alias("budget"))


def row_key(seed: str) -> Column:
    """The hash-random key: md5 of seed, id and the text's md5."""
    return F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.md5(whole_text().cast("binary"))).cast("binary"))


def narrow(docs: DataFrame, seed: str) -> DataFrame:
    """no_source, source, doc_id, size, row_key for every row."""
    size = F.regexp_count(whole_text(), F.lit(WORD)).cast("long")
    return docs.select(F.col("source").isNull().alias("no_source"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.col("doc_id"), size.alias("size"), row_key(seed).alias("row_key"))


def before(by: list[str], order: list[str]):
    """The window of all rows that come earlier."""
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def cuts(rows: DataFrame, slice_rows: int = SLICE, **settings) -> DataFrame:
    """One row per source: no_source, source, source_size, target, epochs, cut_key and at_cut.

    Documents of a smaller key than cut_key are taken epochs + 1 times, those of
    a larger one epochs times. at_cut counts the words to take of the documents
    of that key, in the order of (doc_id, size), beyond their epochs. Without a
    cut key, all are taken epochs times.
    """
    sources = written(rows.groupBy(*BY).agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), "mix-sources")
    want = targets(sources.drop("n"), **settings)
    epochs = F.coalesce(F.floor(F.col("budget") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0)).cast("long")
    want = want.join(sources.select(*BY, "n"), BY).withColumn("epochs", epochs)
    want = written(want.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size")), "mix-targets")
    placed = by_source(rows, want.select(*BY, "n"))
    # the first 48 bits of the key, as a share of their range
    place = F.conv(F.substring("row_key", 1, 12), 16, 10).cast("double") / 2.0**48
    placed = placed.withColumn("slice", F.floor(place * F.ceil(F.col("n") / slice_rows)).cast("long"))
    slices = placed.groupBy(*BY, "slice").agg(F.sum("size").alias("words")).withColumn("block", F.floor(F.col("slice") / BLOCK))
    slices = written(slices, "mix-slices")
    blocks = slices.groupBy(*BY, "block").agg(F.sum("words").alias("words"))
    blocks = blocks.select(*BY, "block", F.coalesce(F.sum("words").over(before(BY, ["block"])), F.lit(0)).alias("block_start"))
    starts = slices.withColumn("start", F.coalesce(F.sum("words").over(before([*BY, "block"], ["slice"])), F.lit(0))).join(blocks, [*BY, "block"])
    starts = starts.withColumn("start", F.col("start") + F.col("block_start")).join(want.select(*BY, "rest"), BY)
    # the slice with start <= rest < start + words: at most one of each source
    hit = starts.where("start <= rest and rest < start + words").select(*BY, "slice", (F.col("rest") - F.col("start")).alias("rest"))
    inside = placed.join(hit, [*BY, "slice"]).groupBy(*BY, "row_key", "rest").agg(F.sum("size").alias("words"))
    inside = inside.withColumn("start", F.coalesce(F.sum("words").over(before(BY, ["row_key"])), F.lit(0)))
    cut = inside.where("start <= rest and rest < start + words").select(*BY, F.col("row_key").alias("cut_key"), (F.col("rest") - F.col("start")).alias("at_cut"))
    out = written(want.join(cut, BY, "left").select(*BY, "source_size", "target", "epochs", "cut_key", F.coalesce("at_cut", F.lit(0)).alias("at_cut")), "mix-cuts")
    discard(sources, want, slices)
    return out


def by_source(x: DataFrame, sources: DataFrame) -> DataFrame:
    """x with the columns of sources; these are broadcast up to BROADCAST_SOURCES rows."""
    few = sources.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    return x.join(F.broadcast(sources) if few else sources, BY)


def repeated(x: DataFrame, copies: str) -> DataFrame:
    """Each row as often as the column says, which goes. Copies are cut into
    chunks of CHUNK, which are dealt out before they are exploded."""
    x = x.where(F.col(copies) > 0).withColumn("_chunk", F.explode(F.expr(f"sequence(0L, cast({copies} as bigint) - 1, {CHUNK}L)")))
    x = x.withColumn(copies, F.least(F.lit(CHUNK).cast("long"), F.col(copies) - F.col("_chunk")))
    x = x.repartition(int(x.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_chunk", *[c for c in x.columns if c not in ("row", "_chunk")])
    return x.withColumn("_copy", F.explode(F.expr(f"sequence(1L, {copies})"))).drop("_copy", "_chunk", copies)


def mix(docs: DataFrame, seed: str = "mix", slice_rows: int = SLICE, **settings) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row."""
    rows = written(narrow(docs, seed), "mix")
    x = by_source(rows, cuts(rows, slice_rows, **settings))
    key, cut = F.col("row_key"), F.col("cut_key")
    more = F.when(cut.isNotNull() & (key < cut), 1).otherwise(0)
    plain = x.where(cut.isNull() | (key != cut)).select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("epochs") + more)).cast("long").alias("taken"))
    # the documents at the cuts, a few for each source; alike ones are counted
    alike = x.where(key == cut).groupBy(*BY, "doc_id", "size", "source_size", "target", "epochs", "at_cut").agg(F.count("*").alias("m"))
    start = F.coalesce(F.sum(F.col("size") * F.col("m")).over(before(BY, ["doc_id", "size"])), F.lit(0))
    left = F.greatest(F.lit(0), F.least(F.col("size") * F.col("m"), F.col("at_cut") - start))
    alike = alike.withColumn("left", left)
    # of m alike documents the first ones are taken whole, one in part, the others not
    whole = F.coalesce(F.floor(F.col("left") / F.nullif(F.col("size"), F.lit(0))), F.lit(0))
    some = F.col("left") - whole * F.col("size")
    shares = F.array(F.struct(whole.alias("copies"), F.col("size").alias("more")), F.struct(F.when(some > 0, 1).otherwise(0).cast("long").alias("copies"), some.alias("more")), F.struct((F.col("m") - whole - F.when(some > 0, 1).otherwise(0)).alias("copies"), F.lit(0).cast("long").alias("more")))
    dealt = alike.withColumn("share", F.explode(shares)).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("epochs") + F.col("share.more")).cast("long").alias("taken"), F.col("share.copies").alias("copies"))
    return plain.unionByName(repeated(dealt, "copies"))


def mixed_rows(docs: DataFrame, seed: str = "mix", slice_rows: int = SLICE, **settings) -> DataFrame:
    """The rows of docs as the mix holds them: whole documents, repeated by epoch.

    A document on a source's cut stays if at least half of it is taken, so a
    source is off its target by half a document at most. Each row stands for
    itself: rows that share an id, a text or both, in one source or in several,
    have their own copies, and no row takes another's place. Rows before a
    source's cut are repeated once more than those behind it, rows without words
    too; the rows of a source without words go. Null ids, null texts, repeated
    rows and an empty table are as in `mix`; other columns are kept as they are.
    """
    rows = written(narrow(docs, seed), "mix")
    plan = cuts(rows, slice_rows, **settings)
    discard(rows)
    columns = [c for c in docs.columns]
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col("source").isNull().alias("no_source"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), row_key(seed).alias("row_key"))
    x = by_source(own, plan)
    key, cut = F.col("row_key"), F.col("cut_key")
    more = F.when(cut.isNotNull() & (key < cut), 1).otherwise(0)
    plain = x.where(cut.isNull() | (key != cut)).select("row", (F.col("epochs") + more).alias("copies")).where("copies > 0")
    # rows at a cut: alike ones are counted; what tells the others apart is a hash of all columns
    same = F.xxhash64(F.to_json("row"))
    tied = x.where(key == cut).withColumn("size", F.regexp_count(F.coalesce(F.col("row.text").cast("string"), F.lit("")), F.lit(WORD)).cast("long"))
    tied = tied.groupBy(*BY, same.alias("same"), "size", "epochs", "at_cut").agg(F.first("row").alias("row"), F.count("*").alias("m"))
    start = F.coalesce(F.sum(F.col("size") * F.col("m")).over(before(BY, ["same"])), F.lit(0))
    left = F.greatest(F.lit(0), F.least(F.col("size") * F.col("m"), F.col("at_cut") - start))
    tied = tied.withColumn("whole", F.floor(F.coalesce(left / F.nullif(F.col("size"), F.lit(0)), F.lit(0)) + 0.5).cast("long"))
    dealt = tied.select("row", (F.col("m") * F.col("epochs") + F.col("whole")).alias("copies"))
    plain = plain.withColumn("_copy", F.explode(F.expr("sequence(1L, copies)"))).select("row")
    return plain.unionByName(repeated(dealt, "copies")).select("row.*")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents: weights 5, 2, 1 over the sources, 150 % of all words."""
    return mix(table(spark, sf_dir, "documents"))


def oracle() -> str:
    return r"""
    WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                      md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS k FROM documents),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
    w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
    r AS (SELECT *, 2 * source_size AS cap, CAST(2 * source_size AS DOUBLE) / weight AS r FROM w),
    l AS (SELECT *, row_number() OVER (ORDER BY r, source NULLS LAST) AS pos,
                 (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY r, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                 / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY r, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM r),
    m AS (SELECT arg_min(level, pos) AS level FROM l WHERE r > level),
    t AS (SELECT source, source_size, coalesce(least(CAST(cap AS DOUBLE), m.level * weight), CAST(cap AS DOUBLE)) AS target FROM l CROSS JOIN m),
    b AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS budget, coalesce(CAST(floor(floor(target + 0.5) / nullif(source_size, 0)) AS BIGINT), 0) AS epochs FROM t),
    p AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d)
    SELECT doc_id, size, source_size, target,
           CAST(size * epochs + greatest(0, least(size, budget - epochs * source_size - start)) AS BIGINT) AS taken
    FROM p JOIN b ON p.source IS NOT DISTINCT FROM b.source
    """
