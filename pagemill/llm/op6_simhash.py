"""SimHash near-duplicates through segment popcounts.

A fingerprint's 16 segments of four bits become a point of 16 bit counts. The
Manhattan distance of two points is at most the Hamming distance of their
fingerprints, so fingerprints within two bits lie within two steps on the grid,
and then some grid point is within one step of both. Each distinct fingerprint
is put into the cells of its own point and of the points one step away (33 at
most); pairs that share a cell are verified exactly.

A cell with many fingerprints (a large group of near copies) is not paired off:
its fingerprints go to the values one bit away from each. Two that share such a
value are within two bits, and any two within two bits share one; a star round
each value's smallest fingerprint gives the same components at 65 rows a
fingerprint, whatever the group's size.

Copies are one fingerprint from the start; components are found among distinct
fingerprints.

Defined results: null and empty texts, and texts of white space, have the
fingerprint zero and link like any other; a very long text is hashed in parts of
65,536 shingles; a bit set in just half of them is 0; null ids and repeated rows keep their
rows, null ids count for no component's smallest id (null where there is no
other); an empty table gives an empty result; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, table, whole_text, written

SHINGLE = 3
SEED = 42
SEGMENTS, SEGMENT_BITS = 16, 4
#: Larger cells are joined through exact one-bit neighbours.
PAIRED_CELL = 64


def simhash(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint as a signed 64-bit number."""
    import xxhash

    words = text.encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    runs = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    n = max(1, len(words) - shingle + 1)
    return majority(np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=seed), runs), np.uint64, n))


def majority(h: np.ndarray) -> int:
    """The signed number of the bits that are set in over half the hashes; zero for none."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 65_536):
        ones += np.unpackbits(h[i : i + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([simhash(x.as_py()) for x in b.column("text")], pa.int64())], ["doc_id", "fp"])


def cells(classes: DataFrame) -> DataFrame:
    """(cell, fp): the grid points within one step of each fingerprint's point."""
    side = SEGMENT_BITS + 1
    count = [F.bit_count(F.shiftrightunsigned("fp", SEGMENT_BITS * i).bitwiseAND(F.lit(2**SEGMENT_BITS - 1))).cast("long") for i in range(SEGMENTS)]
    x = classes.select("fp", F.array(*count).alias("v"))
    x = x.select("fp", "v", sum((F.col("v")[i] * side**i for i in range(SEGMENTS)), F.lit(0).cast("long")).alias("own"))
    steps = [F.when(F.col("v")[i] > 0, F.col("own") - side**i) for i in range(SEGMENTS)] + [F.when(F.col("v")[i] < SEGMENT_BITS, F.col("own") + side**i) for i in range(SEGMENTS)]
    return x.select("fp", F.explode(F.array(F.col("own"), *steps)).alias("cell")).where("cell is not null")


def links(classes: DataFrame, most: int = 2) -> DataFrame:
    """(a, b) pairs of distinct fingerprints that differ in up to two bits, enough
    of them that their components are those of all such pairs."""
    if most != 2:
        raise ValueError("the grid and the one-bit neighbours are laid out for two bits")
    placed = cells(classes)
    full = written(placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"), "simhash-cells")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most
    two = full.where("n = 2").select("a", "b")
    some = placed.join(full.where(f"n between 3 and {PAIRED_CELL}").select("cell"), "cell")
    few = some.select("cell", F.col("fp").alias("a")).join(some.select("cell", F.col("fp").alias("b")), "cell").where("a < b").select("a", "b")
    crowd = placed.join(full.where(f"n > {PAIRED_CELL}").select("cell"), "cell").select("fp").distinct()
    one_off = crowd.select("fp", F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")) for i in range(64)])).alias("value"))
    hub = one_off.groupBy("value").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1")
    stars = one_off.join(hub, "value").select(F.col("fp").alias("a"), "b").where("a <> b")
    return two.union(few).union(stars).where(near).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp (signed), component_id for every row."""
    fps = docs.select("doc_id", whole_text().alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")
    fps = written(fps, "simhash")
    classes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-classes")
    roots = components(links(classes), "simhash-components")
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    # both sides of the last join are plain scans, so a fingerprint of very many rows is split there
    return fps.join(written(rooted.join(smallest, "root").select("fp", "component_id"), "simhash-roots"), "fp")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents."""
    x = near_duplicates(table(spark, sf_dir, "documents"))
    return x.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
