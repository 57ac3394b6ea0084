"""Near copies of texts: word shingles with a Jaccard similarity of LEAST or more.

A text is the set of its shingles of WORDS words (one shingle of all words where
there are fewer). Texts of one set are one class from the start. The first candidates
are `op6_simhash`'s: classes whose fingerprints of these shingles are within two
bits, from its grid of segment popcounts. Two bits hold the close copies (at a
similarity of 0.8 fingerprints differ by ten bits), so classes that these links
have not joined are also candidates where they share a band of minhashes: at a
similarity of 0.8, BANDS bands of BAND minhashes miss a pair with a probability of
3e-6. Every candidate is verified by its exact similarity; the components of the
links of both are the groups.

Members of a bucket of a band are paired off where they are PAIRED_BUCKET at most.
Members of larger ones are first compared with HUBS of them. Then only members of
different components are, those outside the bucket's largest component with all
others, in tiles of about TILE x TILE texts that return joined components and no
pairs. No candidate pair of two components is left uncompared. The work in tiles
still grows with the square of a group whose texts are near LEAST but below it.

Defined results: null and empty texts, and texts of white space, are the empty
set, and alike; null ids and repeated rows keep their rows; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, tidy, whole_text, written
from .op6_simhash import links as fingerprint_links
from .op6_simhash import majority

WORDS, LEAST = 5, 0.8
BANDS, BAND = 32, 5
PAIRED_BUCKET, HUBS, TILE = 8, 8, 512


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Ascending hashes of the text's shingles, each once."""
    import xxhash

    w = text.encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII white space only
    if not w:
        return np.zeros(0, np.uint64)
    runs = map(b" ".join, zip(*(w[i:] for i in range(words)))) if len(w) >= words else [b" ".join(w)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, runs), np.uint64, max(1, len(w) - words + 1)))


def bands(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """The keys of the bands; none for the empty set."""
    import xxhash

    if not len(h):
        return np.zeros(0, np.int64)
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 2**63, BANDS * BAND, np.uint64) << np.uint64(1) | np.uint64(1)
    b = rng.integers(0, 2**63, BANDS * BAND, np.uint64)
    low = np.full(BANDS * BAND, 2**64 - 1, np.uint64)
    for i in range(0, len(h), 512):
        x = (h[i : i + 512, None] ^ b) * a
        low = np.minimum(low, (x ^ x >> np.uint64(32)).min(axis=0))
    rows = low.reshape(BANDS, BAND)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), seed=i) for i, r in enumerate(rows)], np.uint64).view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two ascending sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for b in batches:
        sets = [shingles(x.as_py()) for x in b.column("text")]
        node = np.array([xxhash.xxh3_64_intdigest(h.tobytes()) for h in sets], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row_key"), b.column("text_key"), pa.array(node), pa.array([majority(h) for h in sets], pa.int64()), pa.array([bands(h) for h in sets], pa.list_(pa.int64()))], ["doc_id", "row_key", "text_key", "node", "fp", "bands"])
        del sets
        tidy()


def text_key():
    """A hash of the text, by which rows find their text again."""
    return F.xxhash64(whole_text())


def row_key(docs: DataFrame):
    """A hash of all columns: rows of one id that differ anywhere have different keys."""
    return F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns])))


def verified(pairs: DataFrame, sets: DataFrame, least: float = LEAST) -> DataFrame:
    """The pairs (a, b) whose similarity is `least` or more."""
    x = pairs.join(sets.select(F.col("node").alias("a"), F.col("h").alias("ha")), "a").join(sets.select(F.col("node").alias("b"), F.col("h").alias("hb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            keep = [similarity(np.frombuffer(p.as_py(), np.uint64), np.frombuffer(q.as_py(), np.uint64)) >= least for p, q in zip(t.column("ha"), t.column("hb"))]
            yield t.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        tidy()

    return x.select("a", "b", "ha", "hb").mapInArrow(run, "a long, b long")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> Iterator[np.ndarray]:
    """For each set of left its similarity with each of right."""
    size = np.array([len(h) for h in right])
    value, at = np.unique(np.concatenate(right), return_inverse=True)
    order = np.argsort(at, kind="stable")
    owner = np.repeat(np.arange(len(right)), size)[order]
    start = np.append(0, np.cumsum(np.bincount(at, minlength=len(value))))
    for h in left:
        own = np.minimum(np.searchsorted(value, h), len(value) - 1)
        own = own[value[own] == h]
        n = start[own + 1] - start[own]
        places = np.repeat(start[own] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum()) if len(own) else np.zeros(0, np.int64)
        both = np.bincount(owner[places], minlength=len(right))
        yield both / (len(h) + size - both)


def across(x: DataFrame, sets: DataFrame, least: float, tile: int = TILE) -> DataFrame:
    """(a, b): roots that a link joins, between members (band, node, root) of a bucket."""
    groups = x.groupBy("band", "root").agg(F.count("*").alias("n")).groupBy("band").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max(F.struct("n", "root")).getField("root").alias("main")).where("n > most")
    blocks = lambda n: F.ceil(n / F.lit(tile)).cast("int")
    groups = groups.select("band", "main", blocks(F.col("n") - F.col("most")).alias("is"), blocks(F.col("n")).alias("js"))
    x = x.join(groups, "band").join(sets, "node")
    block = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = x.where("root <> main").select("band", block(F.col("is")).alias("i"), every("js").alias("j"), F.lit(True).alias("left"), "root", "h")
    right = x.select("band", every("is").alias("i"), block(F.col("js")).alias("j"), F.lit(False).alias("left"), "root", "h")

    def run(key, t):
        tidy()
        side = t.column("left").to_numpy()
        a, b = t.filter(pa.array(side)), t.filter(pa.array(~side))
        out: set[tuple[int, int]] = set()
        if a.num_rows and b.num_rows:
            hashes = lambda c: [np.frombuffer(v.as_py(), np.uint64) for v in c.column("h")]
            roots = b.column("root").to_numpy()
            for root, near in zip(a.column("root").to_pylist(), overlaps(hashes(a), hashes(b))):
                out.update((root, r) for r in set(roots[near >= least].tolist()) if r != root)
        return pa.table({"a": pa.array([p for p, _ in out], pa.int64()), "b": pa.array([q for _, q in out], pa.int64())})

    # one key, or all tiles of a band would stay in the task that its join left them in
    tiles = left.union(right).withColumn("tile", F.concat_ws("/", "band", "i", "j")).drop("band", "i", "j")
    return tiles.groupBy("tile").applyInArrow(run, "a long, b long").distinct()


def close(classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes (node, fp) whose fingerprints are within two bits, enough of them that their
    components are those of all such pairs: each class with the first of its fingerprint, and first ones."""
    first = written(classes.groupBy("fp").agg(F.min("node").alias("b")), "near-fingerprints")
    of = lambda c: first.select(F.col("fp").alias(f"fp_{c}"), F.col("b").alias(c))
    near = fingerprint_links(first.select("fp")).select(F.col("a").alias("fp_a"), F.col("b").alias("fp_b"))
    near = near.join(of("a"), "fp_a").join(of("b"), "fp_b").select("a", "b")
    return classes.select(F.col("node").alias("a"), "fp").join(first, "fp").select("a", "b").union(near)


def near_texts(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, row_key, text_key, root for every row: rows of one root are near copies."""
    rows = written(docs.select("doc_id", row_key(docs).alias("row_key"), text_key().alias("text_key"), whole_text().alias("text")).mapInArrow(_signed, "doc_id long, row_key long, text_key long, node long, fp long, bands array<long>"), "near-rows")
    # any row of a class stands for it
    first = rows.groupBy("node").agg(F.min_by("bands", "text_key").alias("bands"), F.min("text_key").alias("text_key"))
    placed = first.select("node", "text_key", F.explode("bands").alias("band"))
    hub = [F.min(F.struct(F.xxhash64("node", F.lit(i)), "node")).getField("node") for i in range(HUBS)]
    full = placed.groupBy("band").agg(F.count("*").alias("n"), F.array(*hub).alias("hubs")).where("n > 1")
    members = written(placed.join(full, "band"), "near-members")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([shingles(x.as_py()).tobytes() for x in b.column("text")], pa.binary())], ["node", "h"])

    ordered = lambda x: x.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    classes = written(rows.groupBy("node").agg(F.min("fp").alias("fp"), F.min("text_key").alias("text_key")), "near-classes")
    nearest = written(ordered(close(classes)), "near-close")
    ends = nearest.select(F.col("a").alias("node")).union(nearest.select(F.col("b").alias("node"))).distinct()
    need = members.select("node", "text_key").union(classes.join(ends, "node").select("node", "text_key")).distinct()
    texts = docs.select(text_key().alias("text_key"), whole_text().alias("text")).join(need, "text_key").groupBy("node").agg(F.first("text").alias("text"))
    sets = written(texts.mapInArrow(sets_of, "node long, h binary"), "near-sets")

    copies = written(verified(nearest, sets, least), "near-copies")
    close_roots = written(components(copies, "near-components"), "near-close-roots")
    small = members.where(f"n <= {PAIRED_BUCKET}")
    pairs = small.select("band", F.col("node").alias("a")).join(small.select("band", F.col("node").alias("b")), "band").where("a < b").select("a", "b")
    stars = members.where(f"n > {PAIRED_BUCKET}").select(F.col("node").alias("a"), F.explode("hubs").alias("b"))
    # what the fingerprints' links have joined needs no further one
    root = lambda c: close_roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    apart = ordered(pairs.union(stars)).join(root("a"), "a", "left").join(root("b"), "b", "left").where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b"))
    links = written(verified(apart.select("a", "b"), sets, least).union(copies), "near-links")
    roots = written(components(links, "near-components"), "near-roots")

    x = members.where(f"n > {PAIRED_BUCKET}").select("band", "node").join(roots, "node", "left").select("band", "node", F.coalesce("root", "node").alias("root"))
    joined = written(across(written(x, "near-large"), sets, least), "near-joined")
    if not joined.isEmpty():
        roots = components(links.union(joined), "near-components")
    return rows.select("doc_id", "row_key", "text_key", "node").join(roots, "node", "left").select("doc_id", "row_key", "text_key", F.coalesce("root", "node").alias("root"))


def one_of_each(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """One row of docs of each group of near copies: that with the smallest id, nulls
    last, of rows of one id that with the smallest row key. Rows are told apart by
    their id and a hash of all their columns; rows alike in all are one row."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key"))
    best = near_texts(docs, least).groupBy("root").agg(first.alias("x")).select(F.col("x.doc_id").alias("_id"), F.col("x.row_key").alias("_key"))
    # copies are dropped before the shuffle, which both the aggregate and the join use
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("i"), F.col("doc_id").isNull().alias("no_id"), row_key(docs).alias("k"))
    own = own.groupBy("i", "no_id", "k").agg(F.first("row").alias("row"))
    best = best.select(F.coalesce("_id", F.lit(0)).alias("i"), F.col("_id").isNull().alias("no_id"), F.col("_key").alias("k"))
    return own.join(best, ["i", "no_id", "k"], "left_semi").select("row.*")
