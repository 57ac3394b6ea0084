"""Near-duplicate embeddings by NN-descent.

Equal vectors are one class from the start. Each class begins with neighbours
that stand next to it in the order of random sign codes. A round joins the
neighbours of each class, forward and reverse, with one another, where one is
new, and keeps for each class the LIST best; rounds end when few lists change. Every pair seen with
the threshold cosine or more is kept as a link, whether or not it stays in a list.

A list all of whose entries are links is saturated: there may be more. It is
enlarged to twice its length, again and again, up to MOST_LIST entries, and the
rounds go on with the longer lists. Classes with more links than that stand in
a crowd: the component of links around one is compared as a whole, in tiles of
two blocks of up to CROWD_TILE vectors that return sums for each vector and not pairs, which
is exact whatever the component's size.

A pair at the threshold shares the leading bits of a code that tell n vectors of
a label apart with a probability that falls with n; the number of codes grows so
that GOOD_RECALL of such pairs, alone as they may be, meet in one of them. Codes
are range-sorted with the class as the last key, so a group of near copies with
one code is dealt over as many tasks as it needs.

Recall is audited: bounded samples of classes (of all, of those outside the
crowds, and of those outside with a link or a near miss) are compared with all
vectors of their label. Links within a crowd are found by construction and do
not count. A sample that has fewer than LEAST_TRUE true links is widened, up to
MOST_AUDIT classes. Below GOOD_RECALL the search goes on with lists twice as long
and new codes; a last audit below LEAST_RECALL raises an error. The result
carries the audited recall and the number of true links behind it.

Cosines are taken in double precision from the vectors as given; wherever a
product of matrices comes within NEAR of the threshold, the sum over the two
rows decides, so a pair is a link everywhere or nowhere. Labels and vector
lengths must be equal. Classes are told apart by two 64-bit hashes.

Defined results: a vector that is null, empty or zero or has null or non-finite
components, or has no label, links with nothing (no links, its own component);
rows alike in all three columns are one vector and get the same result; rows
with null ids link with nothing and have a null component; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import components, discard, table, written

THRESHOLD = 0.93
LIST, MOST_LIST = 8, 32
CODES, CODE_BITS, CODE_WINDOW = 4, 32, 2
MOST_ROUNDS = 6
#: Rows of a product of matrices; rows, and bytes, of a block of a crowd.
TILE, CROWD_TILE, TILE_BYTES = 512, 8192, 64_000_000
AUDIT, MOST_AUDIT, LEAST_TRUE, NEAR_MISS = 500, 8000, 200, 0.05
GOOD_RECALL, LEAST_RECALL, SEARCHES = 0.98, 0.9, 3
NEAR = 1e-9


def matrix(lists: pa.Array) -> np.ndarray:
    """Vectors of one length as unit rows in double precision."""
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = values.reshape(len(lists), -1)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def cosines(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Of unit rows, each of x with each of y. Those near the threshold are sums over
    the two rows, as `scored` takes them: the order of a product's sums varies."""
    g = x @ y.T
    i, j = np.nonzero(np.abs(g - threshold) < NEAR)
    g[i, j] = (x[i] * y[j]).sum(axis=1)
    return g


def with_class(rows: DataFrame) -> DataFrame:
    """rows and `hash`, two hashes of label and vector, null where a vector can't link."""
    e = F.col("embedding")
    norm = F.aggregate(e, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & e.isNotNull() & (F.size(e) > 0) & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & (norm > 0) & (norm < float("inf"))
    two = F.struct(F.xxhash64("label", "embedding").alias("h1"), F.xxhash64(F.lit("other"), "label", "embedding").alias("h2"))
    return rows.withColumn("hash", F.when(F.coalesce(fine, F.lit(False)), two))


def code_count(n: int, threshold: float) -> int:
    """How many codes make GOOD_RECALL of the pairs at the threshold neighbours in
    one of them, among n vectors: by then they share about log2(n) bits."""
    agree = 1 - np.arccos(min(1.0, threshold)) / np.pi
    once = agree ** max(1.0, np.log2(max(2, n)) - 1)
    return max(CODES, int(np.ceil(np.log(1 - GOOD_RECALL) / np.log1p(-min(once, 0.99)))))


def first_pairs(vectors: DataFrame, seed: int, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b): classes that stand within CODE_WINDOW places in the order of a code.
    Where a range of the order ends, its last places meet the next only by other codes."""
    most = vectors.groupBy("space").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    number = code_count(most, threshold)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            for d in set(b.column("dim").to_pylist()):
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, d]).normal(size=(d, number * CODE_BITS))
                here = b.filter(pa.array(b.column("dim").to_numpy() == d))
                bits = (matrix(here.column("embedding")) @ planes[d] > 0).reshape(-1, number, CODE_BITS).astype(np.int64)
                code = (bits << np.arange(CODE_BITS - 1, -1, -1)).sum(axis=2)
                k = len(code)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(here.column("node").to_numpy(), number)), pa.array(np.repeat(here.column("space").to_numpy(), number)), pa.array(np.tile(np.arange(number, dtype=np.int32), k)), pa.array(code.ravel())], ["node", "space", "code", "bits"])

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            if last is not None:
                t = pa.concat_tables([last, t])
            node, space, code = (t.column(c).to_numpy() for c in ("node", "space", "code"))
            old = 0 if last is None else last.num_rows
            out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
            for i in range(1, CODE_WINDOW + 1):
                near = (space[i:] == space[:-i]) & (code[i:] == code[:-i]) & (node[i:] != node[:-i])
                near[: max(0, old - i)] = False  # pairs of the batch before
                out.append((node[:-i][near], node[i:][near]))
            x, y = (np.concatenate(c) for c in zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])
            last = t.slice(max(0, t.num_rows - CODE_WINDOW))

    order = ["space", "code", "bits", "node"]
    x = written(vectors.select("node", "space", "dim", "embedding").mapInArrow(codes, "node long, space long, code int, bits long"), "nn-codes")
    ranges = int(x.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return x.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("node", "space", "code").mapInArrow(neighbours, "a long, b long").distinct()


def scored(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(a, b, cos) of pairs (a, b)."""
    v = vectors.select("node", "embedding")
    x = pairs.join(v.select(F.col("node").alias("a"), F.col("embedding").alias("va")), "a").join(v.select(F.col("node").alias("b"), F.col("embedding").alias("vb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = b.column("va").value_lengths().to_numpy()
            for d in np.unique(size):
                here = b.filter(pa.array(size == d))
                cos = (matrix(here.column("va")) * matrix(here.column("vb"))).sum(axis=1)
                yield pa.RecordBatch.from_arrays([here.column("a"), here.column("b"), pa.array(cos)], ["a", "b", "cos"])

    return x.select("a", "b", "va", "vb").mapInArrow(run, "a long, b long, cos double")


def room(links):
    """How many entries a list of so many links may have: LIST, or twice that while all are links."""
    size = F.lit(MOST_LIST)
    k = MOST_LIST // 2
    while k >= LIST:
        size = F.when(links < k, F.lit(k)).otherwise(size)
        k //= 2
    return size


def best(pairs: DataFrame, most: int, threshold: float) -> DataFrame:
    """The best b of each a, from (a, b, cos) in either order: `most`, and more where
    these are all links."""
    both = pairs.select("a", "b", "cos").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "cos")).groupBy("a", "b").agg(F.max("cos").alias("cos"))
    w = Window.partitionBy("a")
    ranked = both.withColumn("at", F.row_number().over(w.orderBy(F.desc("cos"), "b"))).where(f"at <= {max(most, MOST_LIST)}")
    ranked = ranked.withColumn("links", F.count_if(F.col("cos") >= threshold).over(w))
    return ranked.where(F.col("at") <= F.greatest(F.lit(most), room(F.col("links")))).select("a", "b", "cos")


def tree(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(child, parent): edges of a symmetric matrix that join all that it joins, one for each child."""
    todo, out = near.any(axis=1), [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    while todo.any():
        reached = np.array([np.argmax(todo)])
        todo[reached] = False
        while len(reached):
            to = near[reached] & todo
            found = np.flatnonzero(to.any(axis=0))
            out.append((found, reached[to[:, found].argmax(axis=0)]))
            todo[found] = False
            reached = found
    child, parent = (np.concatenate(c) for c in zip(*out))
    return child, parent


def local_join(lists: DataFrame, vectors: DataFrame, most: int, threshold: float) -> DataFrame:
    """(a, b, cos) of pairs of neighbours of one class that are links or better than
    what one of them has in its list; of pairs in which an entry is new. Reverse
    neighbours: the `most` best; others meet the class from their own lists.

    Of two classes whose lists are full of links to the last entry, the component is
    compared as a whole later: of such links as many as join the same classes are enough."""
    back = lists.select(F.col("b").alias("a"), F.col("a").alias("b"), "cos", "fresh")
    back = back.withColumn("at", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cos"), "b"))).where(f"at <= {most}").select("a", "b", "fresh")
    around = lists.select("a", "b", "fresh").union(back).groupBy("a", "b").agg(F.max("fresh").alias("fresh"))
    low, n = F.min("cos"), F.count("*")
    state = lists.groupBy(F.col("a").alias("b")).agg(F.when(n >= most, low).alias("worst"), ((n >= max(most, MOST_LIST)) & (low >= threshold)).alias("full"))
    v = vectors.select(F.col("node").alias("b"), "embedding").join(state, "b", "left").select("b", "embedding", F.coalesce("worst", F.lit(-2.0)).alias("worst"), F.coalesce("full", F.lit(False)).alias("full"))
    groups = around.join(v, "b").groupBy("a").agg(F.collect_list(F.struct("b", "embedding", "worst", "full", "fresh")).alias("near"), F.max("fresh").alias("any")).where("any")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            near = batch.column("near")
            ends, flat = near.value_lengths().to_numpy().cumsum(), near.flatten()
            if not len(flat):
                continue
            ids, worst, full, fresh = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("b", "worst", "full", "fresh"))
            x = matrix(flat.field("embedding"))
            for lo, hi in zip(np.append(0, ends[:-1]), ends):
                g = cosines(x[lo:hi], x[lo:hi], threshold)
                w, f, s = worst[lo:hi], fresh[lo:hi], full[lo:hi]
                new, link, both = f[:, None] | f[None, :], g >= threshold, s[:, None] & s[None, :]
                i, j = np.nonzero(np.triu((link | (g > np.minimum(w[:, None], w[None, :]))) & new & ~both, 1))
                crowd = link & new & both
                np.fill_diagonal(crowd, False)
                child, parent = tree(crowd)
                i, j = np.append(i, child), np.append(j, parent)
                out.append((ids[lo:hi][i], ids[lo:hi][j], g[i, j]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["a", "b", "cos"])

    return groups.select("near").mapInArrow(run, "a long, b long, cos double")


def descend(vectors: DataFrame, most: int, threshold: float, seed: int, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(lists, links): the final lists (a, b, cos) and all links seen (a < b)."""
    pairs = scored(first_pairs(vectors, seed, threshold), vectors)
    if known is not None:
        pairs = pairs.union(known)
    seen = written(pairs, "nn-pairs")
    link = lambda x: x.where(F.col("cos") >= threshold).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = [written(link(seen), "nn-links")]
    lists = written(best(seen, most, threshold).withColumn("fresh", F.lit(True)), "nn-lists")
    size = lists.count()
    for _ in range(MOST_ROUNDS if size else 0):
        found = written(local_join(lists, vectors, most, threshold).groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("cos").alias("cos")), "nn-found")
        links.append(written(link(found), "nn-links"))
        now = best(found.union(lists.select("a", "b", "cos")), most, threshold)
        now = written(now.join(lists.select("a", "b", F.lit(True).alias("old")), ["a", "b"], "left").select("a", "b", "cos", F.col("old").isNull().alias("fresh")), "nn-lists")
        discard(lists, found)
        lists = now
        if lists.where("fresh").count() <= 0.005 * size:
            break
    return lists.select("a", "b", "cos"), written(reduce(DataFrame.union, links).distinct(), "nn-links")


def audit(vectors: DataFrame, links: DataFrame, inside: DataFrame, threshold: float, near: DataFrame | None = None, sample: int = AUDIT) -> tuple[float, int]:
    """Share of the true links of bounded samples of classes that are in links, and the
    number of true links. Links between members of one component in `inside` (node, root),
    which was compared as a whole, don't count; near: classes to sample besides."""
    while True:
        got = _audited(vectors, links, inside, threshold, near, sample)
        if got[1] >= LEAST_TRUE or got[2] or sample * 4 > MOST_AUDIT:
            return got[:2]
        sample *= 4


def _audited(vectors: DataFrame, links: DataFrame, inside: DataFrame, threshold: float, near: DataFrame | None, sample: int) -> tuple[float, int, bool]:
    """(recall, true links, whether all classes were asked)."""
    first = lambda x: x.orderBy(F.xxhash64("node"), "node").limit(sample).select("node", "space", "embedding")
    outside = vectors.join(inside, "node", "left_anti")
    few = first(vectors).union(first(outside))
    if near is not None:
        few = few.union(first(outside.join(near, "node", "left_semi")))
    few = few.dropDuplicates(["node"]).toArrow()
    if not few.num_rows:
        return 1.0, 0, True
    ask: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    space = few.column("space").to_numpy()
    for s in np.unique(space):
        here = few.filter(pa.array(space == s)).combine_chunks()
        ask[int(s)] = here.column("node").to_numpy(), matrix(here.column("embedding").combine_chunks())
    asked = vectors.sparkSession.sparkContext.broadcast(ask)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            space = b.column("space").to_numpy()
            for s in np.unique(space):
                if int(s) in asked.value:
                    q, x = asked.value[int(s)]
                    here = b.filter(pa.array(space == s))
                    ids, y = here.column("node").to_numpy(), matrix(here.column("embedding"))
                    for lo in range(0, len(ids), TILE):
                        i, j = np.nonzero(cosines(x, y[lo : lo + TILE], threshold) >= threshold)
                        j += lo
                        keep = q[i] != ids[j]
                        i, j = i[keep], j[keep]
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(q[i], ids[j])), pa.array(np.maximum(q[i], ids[j]))], ["a", "b"])

    true = vectors.select("node", "space", "embedding").mapInArrow(run, "a long, b long").distinct()
    true = true.join(links.withColumn("found", F.lit(True)), ["a", "b"], "left")
    root = lambda c: inside.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    true = true.join(root("a"), "a", "left").join(root("b"), "b", "left")
    true = true.where(~F.coalesce(F.col("ra") == F.col("rb"), F.lit(False)))
    got = true.agg(F.count("*").alias("n"), F.count_if("found").alias("found")).first()
    return (got["found"] / got["n"] if got["n"] else 1.0), got["n"], few.num_rows == vectors.count()


def dealt(members: DataFrame, tile: int = CROWD_TILE) -> DataFrame:
    """Members (root, node, m, embedding) in blocks of `tile` rows (fewer of long vectors, so that a block has
    TILE_BYTES at most), once for each pair of blocks that theirs is in: pair, first (whether theirs is the first
    of the pair), own (whether the pair is one block with itself). A root of n rows makes n * ceil(n / tile) rows."""
    rows = F.least(F.lit(tile), F.greatest(F.lit(1), F.floor(F.lit(TILE_BYTES / 8) / F.max(F.size("embedding")))))
    sizes = members.groupBy("root").agg(F.ceil(F.count("*") / rows).cast("int").alias("blocks"))
    x = members.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    x = x.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # one key, or all tiles of a root would stay in the task that its join left them in
    pair = F.concat_ws("/", "root", F.least("block", "other"), F.greatest("block", "other"))
    return x.select(pair.alias("pair"), (F.col("block") <= F.col("other")).alias("first"), (F.col("block") == F.col("other")).alias("own"), "node", "m", "embedding")


def tiles(members: DataFrame, threshold: float, tile: int = CROWD_TILE) -> DataFrame:
    """(node, links): sums of m over the links of each node within its root, from
    (root, node, m, embedding). Two blocks are all a task holds, and compares once for both."""

    def run(key, t):
        t = t.combine_chunks()
        first, own = t.column("first").to_numpy(), t.column("own").to_numpy().any()
        a = t.filter(pa.array(first)).combine_chunks()
        b = a if own else t.filter(pa.array(~first)).combine_chunks()
        if not a.num_rows or not b.num_rows:
            return pa.table({"node": pa.array([], pa.int64()), "links": pa.array([], pa.int64())})
        x, y = (matrix(z.column("embedding").combine_chunks()) for z in (a, b))
        weight, ids = b.column("m").to_numpy(), a.column("node").to_numpy()
        to_a, to_b = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
        for lo in range(0, len(x), TILE):
            near = cosines(x[lo : lo + TILE], y, threshold) >= threshold
            if own:
                near[np.arange(len(near)), np.arange(lo, lo + len(near))] = False
            to_a[lo : lo + TILE] = near @ weight
            to_b += near.T @ a.column("m").to_numpy()[lo : lo + TILE]
        if own:
            return pa.table({"node": ids, "links": to_a})
        return pa.table({"node": np.append(ids, b.column("node").to_numpy()), "links": np.append(to_a, to_b)})

    return dealt(members, tile).groupBy("pair").applyInArrow(run, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD, most: int = LIST) -> tuple[DataFrame, float, int]:
    """vec_id, n_links, component_id, kept for every row; the audited recall and the true links behind it."""
    own = written(with_class(rows.select("vec_id", "embedding", "label")), "nn-rows")
    each = own.where("hash is not null").groupBy("hash", "vec_id").agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    classes = each.groupBy("hash").agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.min("vec_id").alias("first"), F.count("*").alias("m"))
    classes = classes.select("hash", F.xxhash64("label", F.size("embedding")).alias("space"), F.size("embedding").alias("dim"), "embedding", "first", "m")
    vectors = written(classes.withColumn("node", F.monotonically_increasing_id()), "nn-vectors")
    known, recall, true = None, 0.0, 0
    for search in range(SEARCHES):
        lists, links = descend(vectors, most, threshold, search, known)
        roots = written(components(links, "nn-components"), "nn-roots")
        full = lists.groupBy("a").agg(F.count_if(F.col("cos") >= threshold).alias("n")).where(f"n >= {max(most, MOST_LIST)}").select(F.col("a").alias("node"))
        crowded = written(roots.join(roots.join(full, "node", "left_semi").select("root").distinct(), "root", "left_semi"), "nn-crowded")
        near = lists.where(F.col("cos") >= threshold - NEAR_MISS).select(F.col("a").alias("node")).distinct()
        recall, true = audit(vectors, links, crowded, threshold, near)
        if recall >= GOOD_RECALL:
            break
        known, most = scored(links, vectors).union(lists), 2 * most
    if recall < LEAST_RECALL:
        raise RuntimeError(f"the recall of links is {recall:.3f}")
    m = vectors.select("node", "m")
    counted = tiles(crowded.join(vectors.select("node", "m", "embedding"), "node"), threshold)
    ends = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).join(crowded.select(F.col("node").alias("a")), "a", "left_anti")
    listed = ends.join(m.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("m").alias("links"))
    whole = vectors.select("hash", "node", "first", "m").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(counted.union(listed), "node", "left")
    smallest = whole.groupBy("root").agg(F.min("first").alias("component_id"))
    done = written(whole.join(smallest, "root").select("hash", "component_id", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "nn-result")
    out = own.select("vec_id", "hash").join(done, "hash", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))), recall, true


def op4_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, components and what stays, of all embeddings; the audit's figures in each row."""
    out, recall, true = near_duplicates(table(spark, sf_dir, "embeddings"))
    return out.withColumns({"audited_recall": F.lit(recall), "audited_links": F.lit(true).cast("long")})
