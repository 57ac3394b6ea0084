"""Line dedup over levelled sorted runs of line hashes, in DataFrame operations alone.

A line's key is the MD5 of the line, stripped of ASCII white space and with A-Z
lower-cased; only keys of MIN_CHARS code points or more count. Documents come in
batches. What is known of the keys of earlier batches lies in runs: tables
(key, n: documents holding it, keeper: largest doc_id holding it), bucketed and
sorted by key, so that a batch meets a run, and a run a run, in a merge join
without a shuffle of the run. A batch's keys are counted (pre-aggregated before
their only shuffle), those that a run already knows in enough documents leave by
an anti join with it, and the rest becomes the batch's own run at level 0. When
a level holds FAN runs, they are merged into one of the next level; so a key is
rewritten as often as there are levels, which is the logarithm of the batches.

Batches must come in descending order of doc_id: a key that leaves by an anti
join has its keeper in an earlier batch, and its count is high enough. A folder
of runs outlives the session: `Runs(spark, folder)` takes up what is there, and
a batch that was added is not added again. A run's name tells the batches it
covers, so runs left over from a merge that was cut short are ignored.

At the end the runs are merged, and every document's lines meet the keys in
enough documents. Keys with more than one in SHARE of all lines (SHARE of them at
most) are broadcast; the others, none with more than two in SHARE, are joined by a
shuffle of narrow rows. Texts are shuffled once at most, by document.

Defined results: a null or empty text is one empty line; every row is a document
of its own, so repeated rows count and are treated alike; a null doc_id counts as
smaller than any other, and lines stay where all holders have null ids; of ties for
the largest doc_id all rows keep their lines; very long texts are rows like any
other (their lines' hashes are sorted within the row); an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _without_shuffles, ascii_lower, discard, drop_path, list_dirs, scratch, table, whole_text, written

MIN_CHARS, MIN_DOCS = 40, 5
#: Batches of the query; runs that a level holds until they are merged; a hot key holds more than one in SHARE of the lines.
BATCHES, FAN, SHARE = 4, 2, 65_536
SPACE = " \t\n\x0b\f\r"


def line_key(line: Column, min_chars: int = MIN_CHARS) -> Column:
    """The MD5 of a line's key in hex; null where the key is too short to count."""
    bare = F.btrim(line, F.lit(SPACE))
    return F.when(F.length(bare) >= min_chars, F.md5(ascii_lower(bare).cast("binary")))


def text_id() -> Column:
    """Tells texts of one doc_id apart; equal rows have equal results."""
    return F.unhex(F.md5(whole_text().cast("binary")))


def line_keys(docs: DataFrame, batch: Column, min_chars: int = MIN_CHARS) -> DataFrame:
    """batch, doc_id, text_id, pos (from 0), key, first (of the key in its row) for every line with a key."""
    x = docs.select(batch.alias("batch"), "doc_id", text_id().alias("text_id"), F.split(whole_text(), "\n").alias("lines"))
    keyed = F.filter(F.transform("lines", lambda v, i: F.struct(line_key(v, min_chars).alias("key"), i.alias("pos"))), lambda s: s["key"].isNotNull())
    x = x.withColumn("keys", F.sort_array(keyed)).where(F.size("keys") > 0)
    # sorted by key and place: the first of its key differs from the one before
    flagged = F.transform("keys", lambda s, i: F.struct(s["key"].alias("key"), s["pos"].alias("pos"), ((i == 0) | (s["key"] != F.get("keys", i - 1)["key"])).alias("first")))
    x = x.select("batch", "doc_id", "text_id", F.explode(flagged).alias("k"))
    return x.select("batch", "doc_id", "text_id", "k.pos", F.unhex("k.key").alias("key"), "k.first")


class Runs:
    """Levelled sorted runs in a folder: key, n, keeper."""

    SCHEMA = "key binary, n long, keeper {}"

    def __init__(self, spark: SparkSession, folder: str, keeper: str = "long", buckets: int | None = None, fan: int = FAN):
        """Takes up the runs of the folder, if there are any; the number of buckets is fixed by the first run."""
        self.spark, self.folder, self.fan = spark, folder, fan
        self.columns = self.SCHEMA.format(keeper)
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        found = []
        for name in list_dirs(spark, folder, "_SUCCESS"):
            level, low, high, n = map(int, name.split("-")[1:])
            self.buckets = n
            found.append((level, low, high))
        self.runs = sorted(r for r in found if not any(o != r and o[0] > r[0] and o[1] <= r[1] and r[2] <= o[2] for o in found))

    def _path(self, run: tuple[int, int, int]) -> str:
        return f"{self.folder}/run-{run[0]}-{run[1]}-{run[2]}-{self.buckets}"

    def _table(self, run: tuple[int, int, int]) -> str:
        return f"line_run_{hashlib.md5(self.folder.encode()).hexdigest()}_" + "_".join(map(str, run))

    def read(self, run: tuple[int, int, int]) -> DataFrame:
        """A run by its bucketed table, so that joins by key need no shuffle of it."""
        name = self._table(run)
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(f"CREATE TABLE {name} ({self.columns}) USING parquet OPTIONS (path '{self._path(run)}') CLUSTERED BY (key) SORTED BY (key) INTO {self.buckets} BUCKETS")
        return self.spark.table(name)

    def _write(self, rows: DataFrame, run: tuple[int, int, int]) -> None:
        name = self._table(run)
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        with _without_shuffles(self.spark):
            rows.select("key", "n", "keeper").write.mode("overwrite").format("parquet").bucketBy(self.buckets, "key").sortBy("key").option("path", self._path(run)).saveAsTable(name)

    def _drop(self, run: tuple[int, int, int]) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self._table(run)}")
        drop_path(self.spark, self._path(run))

    def _merged(self, runs: list[tuple[int, int, int]]) -> DataFrame:
        """Runs of disjoint batches as one: a full outer merge join of sorted buckets."""
        def two(a: DataFrame, b: DataFrame) -> DataFrame:
            x = a.join(b.select("key", F.col("n").alias("m"), F.col("keeper").alias("other")), "key", "full")
            return x.select("key", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"), F.greatest("keeper", "other").alias("keeper"))

        return reduce(two, map(self.read, runs))

    def add(self, number: int, lines: DataFrame, enough: int = MIN_DOCS, share: int = SHARE) -> None:
        """Adds batch `number`: the lines (key, first, doc_id) of documents whose ids are not above those of
        earlier batches. Keys of more than `enough` documents and one in `share` of its lines stay in its run, known or not."""
        if any(low <= number <= high for _, low, high in self.runs):
            return
        new = lines.groupBy("key").agg(F.count_if("first").alias("n"), F.max("doc_id").alias("keeper"))
        few = max(enough, lines.count() / share) if self.runs else 0
        for run in self.runs:
            known = self.read(run).where((F.col("n") >= enough) & F.col("keeper").isNotNull()).select(F.col("key").alias("known"))
            new = new.join(known, (F.col("key") == F.col("known")) & (F.col("n") <= few), "left_anti")
        self._write(new, (0, number, number))
        self.runs.append((0, number, number))
        self._compact()

    def _compact(self) -> None:
        level = 0
        while len(same := sorted(r for r in self.runs if r[0] == level)) >= self.fan:
            to = (level + 1, same[0][1], same[-1][2])
            self._write(self._merged(same), to)
            self.runs = sorted([r for r in self.runs if r not in same] + [to])
            for run in same:
                self._drop(run)
            level += 1

    def total(self) -> DataFrame | None:
        """key, n, keeper over all batches; None without a batch. n is exact up to what was enough; beyond, it
        lacks one in `share` of all lines and `enough` a batch at most, so it tells every key with more than two in `share`."""
        return self._merged(self.runs) if self.runs else None

    def close(self) -> None:
        """Takes the tables out of the session's catalog; the files stay."""
        for run in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table(run)}")


def dropped_lines(lines: DataFrame, known: DataFrame, share: int = SHARE) -> DataFrame:
    """doc_id, text_id, dropped (places) of documents that lose lines to known (key, n, keeper)."""
    n_lines = lines.count()
    goes = F.col("keeper").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") < F.col("keeper")))
    hot = written(known.where(F.col("n") * share > n_lines), "lines-hot")
    narrow = lines.select("doc_id", "text_id", "pos", "key")
    first = narrow.join(F.broadcast(hot), "key")
    others = narrow.join(F.broadcast(hot.select("key")), "key", "left_anti").join(known, "key")
    x = first.unionByName(others).where(goes)
    return x.groupBy("doc_id", "text_id").agg(F.collect_set("pos").alias("dropped"))


def without_lines(docs: DataFrame, drops: DataFrame) -> DataFrame:
    """doc_id, lines (of the whole text), dropped (places), kept (text) for every row of docs."""
    d = drops.select(F.col("doc_id").alias("_id"), F.col("text_id").alias("_text"), "dropped")
    own = docs.select("doc_id", whole_text().alias("text")).withColumn("_t", text_id())
    x = own.join(d, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_text")), "left")
    x = x.select("doc_id", "text", F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"), F.split("text", "\n").alias("lines"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "dropped")
    kept = F.when(F.size("dropped") == 0, F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n"))
    return x.select("doc_id", F.size("lines").alias("n_lines"), F.size("dropped").alias("n_dropped"), kept.alias("kept"))


def batches_of(docs: DataFrame, batches: int) -> Column:
    """The batch of a doc_id: near-equal ranges, the largest ids first, nulls last."""
    cuts = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(batches - 1, 0, -1)])).first()[0] or []
    batch = F.lit(len(cuts))
    for i, cut in reversed(list(enumerate(cuts))):
        batch = F.when(F.col("doc_id") > cut, i).otherwise(batch)
    return batch


def dedup(docs: DataFrame, batches: int = BATCHES, fan: int = FAN, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, share: int = SHARE) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept for every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    own = docs.select("doc_id", "text")
    path = scratch(spark, "lines")
    with _without_shuffles(spark):
        line_keys(own, batches_of(own, batches), min_chars).write.option("compression", "zstd").partitionBy("batch").parquet(path)
    schema = f"doc_id {own.schema['doc_id'].dataType.simpleString()}, text_id binary, pos int, key binary, first boolean, batch int"
    lines = spark.read.schema(schema).parquet(path)
    runs = Runs(spark, scratch(spark, "line-runs"), own.schema["doc_id"].dataType.simpleString(), fan=fan)
    for number in range(batches):
        runs.add(number, lines.where(F.col("batch") == number), min_docs, share)
    known = written(runs.total().where(F.col("n") >= min_docs), "lines-known")
    drops = written(dropped_lines(lines, known, share), "lines-dropped")
    for run in list(runs.runs):
        runs._drop(run)
    discard(known)
    drop_path(spark, path)
    return without_lines(own, drops)


def op11_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines without those that five documents or more hold, but in the last of these."""
    x = dedup(table(spark, sf_dir, "documents"))
    return x.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_dropped").cast("long").alias("n_dropped"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def oracle() -> str:
    return r"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
    x AS (SELECT r, doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM d),
    k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM x),
    g AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT r) >= 5),
    m AS (SELECT k.*, keeper IS NOT NULL AND (doc_id IS NULL OR doc_id < keeper) AS dropped FROM k LEFT JOIN g USING (key))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
    FROM m GROUP BY r, doc_id
    """
