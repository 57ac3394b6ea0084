import collections
import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from pagemill.llm import near_texts
from pagemill.llm import op4_nn_descent as nn
from pagemill.llm import op8_mixing as mixing
from pagemill.llm.op3_bradley_terry import op3_bradley_terry

ROWS = "vec_id long, embedding array<float>, label int, node int, m int"


def brute(rows):
    """links and component of each vec_id, by all pairs of distinct rows."""
    seen = {}
    for i, e, l, *_ in rows:
        ok = i is not None and l is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)
        if ok:
            seen[i, l, tuple(e)] = np.array(e, np.float64) / np.linalg.norm(np.array(e, np.float64))
    keys = list(seen)
    links = {k: 0 for k in keys}
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(keys)):
        for b in range(a):
            x, y = keys[a], keys[b]
            if x[1] == y[1] and len(x[2]) == len(y[2]) and seen[x] @ seen[y] >= nn.THRESHOLD:
                links[x] += 1
                links[y] += 1
                root[find(x)] = find(y)
    first = {}
    for k in keys:
        first[find(k)] = min(first.get(find(k), k[0]), k[0])
    return {k[0]: (links[k], first[find(k)]) for k in keys}


def test_links_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(1)
    rows = []
    for label in (1, 2):
        base = rng.normal(size=(60, 16))
        crowd = base[0] + rng.normal(size=(60, 16)) * 0.12  # a saturated group
        chain = [base[1] * np.cos(t) + base[2] * np.sin(t) for t in np.arange(0, 1.5, 0.2)]
        copies = [base[3]] * 12
        for v in [*base, *crowd, *chain, *copies]:
            rows.append((len(rows), [float(np.float32(x)) for x in v], label, 0, 0))
    n = len(rows)
    rows += [(n, None, 1, 0, 0), (n + 1, [0.0] * 16, 1, 0, 0), (n + 2, [float("nan")] * 16, 1, 0, 0), (n + 3, rows[0][1], None, 0, 0), (n + 4, [], 1, 0, 0), (n + 5, [1.0, None], 1, 0, 0), (n + 6, [1.0, 2.0], 1, 0, 0), (n + 7, [1.0, 2.0], 1, 0, 0), (n + 8, [float("inf")] * 16, 1, 0, 0), rows[5], (None, rows[0][1], 1, 0, 0)]
    df = spark.createDataFrame(rows, ROWS)
    got, recall, true = nn.near_duplicates(df)
    want = brute(rows)
    got = got.collect()
    assert len(got) == len(rows) and recall >= 0.98
    for r in got:
        links, root = want.get(r.vec_id, (0, r.vec_id))
        assert (r.n_links, r.component_id, r.kept) == (links, root, r.vec_id is None or r.vec_id == root)
    assert true > 0
    none, *_ = nn.near_duplicates(df.limit(0))
    assert none.count() == 0


def test_pipeline_stages_decide(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_dedup", "mixing", "bpe"]
    out = dict.fromkeys(names)
    x = docs
    for name, stage in corpus_pipeline.STAGES:
        x = out[name] = stage(spark, x, sf).persist()
    rejected = {r.doc_id for r in op3_bradley_terry(spark, sf).where("predicted = 0").collect()}
    assert {r.doc_id for r in out["quality"].collect()} == {r.doc_id for r in docs.collect()} - rejected
    assert all(out[n].columns == docs.columns for n in names[:-1])
    # one of each group stays, by all pairs of the stage's own input
    texts = {r.doc_id: r.text or "" for r in out["quality"].collect()}
    sets, by_shingle = {}, {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[i] = {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        for x in sets[i]:
            by_shingle.setdefault(x, []).append(i)
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = {(a, b) for ids in by_shingle.values() for a in ids for b in ids if a < b} | {(a, b) for a in texts for b in texts if a < b and not sets[a] and not sets[b]}
    for a, b in pairs:
        if not sets[a] or len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    kept = [r.doc_id for r in out["near_dedup"].collect()]
    assert sorted(kept) == sorted({find(i) for i in texts})
    # sources meet their targets within half a document
    mixed = out["mixing"].collect()
    assert {r.doc_id for r in mixed} <= set(kept)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    longest = max(size(texts[i]) for i in kept)
    for p in mixing.cuts(mixing.narrow(out["near_dedup"], "mix")).collect():
        assert abs(sum(size(r.text) for r in mixed if (r.source or "") == p.source and (r.source is None) == p.no_source) - p.target) <= longest / 2 + 0.5
    # and what they hold is encoded
    want = collections.Counter((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in mixed)
    assert collections.Counter((r.doc_id, r.decoded_sha256) for r in out["bpe"].collect()) == want


def test_pipeline_of_odd_rows(spark, sf):
    rows = [(None, "text without an id", None, None, None), (None, "same words here and there", None, None, None), (3, "another text of the same id", "en", "a", 0), (3, "a third text under it", "de", "b", None), (1, None, None, None, None), (2, "", "en", "a", 0), (3, "same words here and there", "en", "a", 0), (3, "same words here and there", "en", "a", 0), (4, "same words here and there", "en", "b", 0)]
    x = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    one = corpus_pipeline.near_dedup(spark, x, sf).collect()
    assert sorted(str(r.doc_id) for r in one) == ["1", "3", "3", "3", "None"]
    for y in (x, x.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            y = stage(spark, y, sf).persist()
        assert y.count() >= 0


@pytest.mark.parametrize("paired", [8, 1])
def test_pipeline_drops_near_copies_by_five_word_similarity(spark, sf, monkeypatch, paired):
    monkeypatch.setattr(near_texts, "PAIRED_BUCKET", paired)
    monkeypatch.setattr(near_texts, "HUBS", paired)
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(3000)]
    rows, texts = [], {}

    def add(w):
        texts[len(rows)] = {" ".join(w[i : i + 5]) for i in range(len(w) - 4)}
        rows.append((len(rows), " ".join(w), "en", "a", 0))

    for edits in (1, 2, 3, 4, 5, 6, 8, 10) * 3:
        w = list(rng.choice(words, 200))
        add(w)
        for _ in range(5):
            x = list(w)
            for at in rng.choice(len(x), edits, replace=False):
                x[at] = "edited"
            add(x)
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in texts:
        for j in range(i):
            if len(texts[i] & texts[j]) / len(texts[i] | texts[j]) >= 0.8:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf).collect()}
    assert kept == {find(i) for i in texts} and len(kept) < len(rows)


def test_near_dedup_links_by_fingerprints_first(spark, sf, monkeypatch):
    """Without minhashes, fingerprints alone join close copies; texts with one fingerprint by chance stay."""
    rng = np.random.default_rng(6)
    rows = []
    for _ in range(3):
        w = list(rng.choice([f"w{i}" for i in range(900)], 900))
        rows += [(len(rows) + k, " ".join([*w[:-1], f"last{k}"]), "en", "a", 0) for k in range(4)]
    rows += [(50, "one of a few", "en", "a", 0), (51, "some other words", "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    monkeypatch.setattr(near_texts, "_signed", _without_bands(near_texts._signed))
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf).collect()) == [0, 4, 8, 50, 51]


def _without_bands(signed):
    def run(batches):
        import pyarrow as pa

        for b in signed(batches):
            none = pa.array([[] for _ in range(b.num_rows)], b.schema.field("bands").type)
            yield b.set_column(b.schema.get_field_index("bands"), "bands", none)

    return run


def test_audit_is_not_carried_by_a_crowd(spark):
    rng = np.random.default_rng(2)
    crowd = rng.normal(size=16) + rng.normal(size=(60, 16)) * 0.05
    alone = np.repeat(rng.normal(size=(40, 16)), 2, axis=0) + rng.normal(size=(80, 16)) * 0.05
    rows = [(i, [float(x) for x in v], 1) for i, v in enumerate([*crowd, *alone])]
    vectors = spark.createDataFrame([(i, 1, v) for i, v, _ in rows], "node long, space long, embedding array<double>")
    inside = spark.createDataFrame([(i, 0) for i in range(60)], "node long, root long")
    every = [(i, i + 1) for i in range(60, 140, 2)]
    part = lambda x: spark.createDataFrame(x, "a long, b long")
    assert nn.audit(vectors, part(every), inside, 0.93) == (1.0, 40)
    assert nn.audit(vectors, part(every[:20]), inside, 0.93) == (0.5, 40)
    assert nn.audit(vectors.where("node < 0"), part(every), inside, 0.93) == (1.0, 0)


def test_a_bounded_sample_finds_rare_links(spark):
    """300 pairs among 12,000 vectors: the sample of near misses and links has most, and missing ones show."""
    rng = np.random.default_rng(7)
    base = rng.normal(size=(11_700, 16))
    rows = [(i, 1, [float(x) for x in v]) for i, v in enumerate([*base, *(base[:300] + rng.normal(size=(300, 16)) * 0.05)])]
    vectors = spark.createDataFrame(rows, "node long, space long, embedding array<double>").persist()
    every = [(i, 11_700 + i) for i in range(300)]
    near = spark.createDataFrame([(i,) for p in every[:200] for i in p], "node long")
    none = spark.createDataFrame([], "node long, root long")
    recall, true = nn.audit(vectors, spark.createDataFrame(every[:200], "a long, b long"), none, 0.93, near)
    assert true >= 200 and recall < 0.99


@pytest.mark.parametrize("longest", [8, 64])
def test_saturated_lists_are_enlarged(spark, monkeypatch, longest):
    """Groups of 30 near copies: in lists of up to 64 entries, or in tiles."""
    monkeypatch.setattr(nn, "MOST_LIST", longest)
    rng = np.random.default_rng(8)
    rows = [(30 * g + i, [float(np.float32(x)) for x in v], 1, 0, 0) for g in range(12) for c in [rng.normal(size=12)] for i, v in enumerate(c + rng.normal(size=(30, 12)) * 0.15)]
    df = spark.createDataFrame(rows, ROWS)
    got, recall, _ = nn.near_duplicates(df)
    want = brute(rows)
    assert {r.vec_id: (r.n_links, r.component_id) for r in got.collect()} == want and max(n for n, _ in want.values()) > 8


def test_a_tree_joins_what_the_matrix_joins():
    rng = np.random.default_rng(3)
    for n in (1, 2, 30):
        near = rng.random((n, n)) < 1.5 / n
        near = (near | near.T) & ~np.eye(n, dtype=bool)
        child, parent = nn.tree(near.copy())
        assert near[child, parent].all() and len(set(child.tolist())) == len(child)

        def labels(a, b):
            out = np.arange(n)
            for _ in range(n):
                np.minimum.at(out, a, out[b])
                np.minimum.at(out, b, out[a])
            return out.tolist()

        assert labels(child, parent) == labels(*np.nonzero(near))


def test_pairs_at_the_threshold_are_links_everywhere_or_nowhere():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 64))
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    at = float((x[3] * x[7]).sum())
    whole = nn.cosines(x, x, at) >= at
    assert whole[3, 7] and (whole == whole.T).all()
    assert all(((nn.cosines(x[i : i + 7], x[j : j + 90], at) >= at) == whole[i : i + 7, j : j + 90]).all() for i in range(0, 400, 7) for j in range(0, 400, 90))


def test_first_pairs_hold_isolated_pairs_of_large_labels(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(5000, 32))
    twin = base[:500] + rng.normal(size=(500, 32)) * 0.3
    x = [(i, 1, 32, [float(c) for c in v]) for i, v in enumerate([*base, *twin])]
    vectors = spark.createDataFrame(x, "node long, space long, dim int, embedding array<double>").persist()
    got = {(r.a, r.b) for r in nn.first_pairs(vectors, 0).collect()}
    cos = (base[:500] * twin).sum(axis=1) / np.linalg.norm(base[:500], axis=1) / np.linalg.norm(twin, axis=1)
    want = [(i, 5000 + i) for i in np.flatnonzero(cos >= nn.THRESHOLD)]
    assert len(want) > 300 and np.mean([p in got for p in want]) >= 0.95


def test_a_crowd_is_compared_in_few_rows(spark):
    """Every pair of a crowd is compared once, whatever the blocks; rows are dealt out by the number of blocks."""
    r = np.random.default_rng(3)
    base = r.normal(size=(3, 8))
    rows = [(int(i % 3), int(i), int(1 + i % 4), (base[i % 3] + 0.25 * r.normal(size=8)).astype(np.float32).tolist()) for i in range(90)]
    members = spark.createDataFrame(rows, "root long, node long, m long, embedding array<float>")
    e = nn.matrix(pa.array([x[3] for x in rows], pa.list_(pa.float32())))
    near = nn.cosines(e, e, 0.93) >= 0.93
    want = {i: sum(rows[j][2] for j in range(90) if j != i and j % 3 == i % 3 and near[i, j]) for i in range(90)}
    assert any(want.values())
    for tile in (1000, 7, 1):
        assert nn.dealt(members, tile).count() == 3 * 30 * -(-30 // tile)
        assert {x.node: x.links for x in nn.tiles(members, 0.93, tile).collect()} == want
    # half of the rows that two sides for each block would make, and a sixteenth of that in blocks of 16 times the rows
    assert nn.dealt(members, 5).count() * 2 == 2 * 90 * 6
