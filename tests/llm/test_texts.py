import collections
import hashlib
import math
import re
import textwrap
import zlib

import numpy as np
import pytest
import xxhash

from conftest import same
from pagemill.llm import op1_katz as katz
from pagemill.llm import op2_warc as warc
from pagemill.llm import op3_bradley_terry as bt
from pagemill.llm import op5_scaled_sketch as sketch
from pagemill.llm import op6_simhash as sim
from pagemill.llm import op8_mixing as mixing
from pagemill.llm import op9_licence as lic
from pagemill.llm import registry
from pagemill.llm.common import scratch

ROWS = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, bucket long, h long, fp long"
rng = np.random.default_rng(3)
WORDS = ["".join(rng.choice(list("abcdeioú"), rng.integers(2, 8))) for _ in range(300)]


def sentence(n):
    return " ".join(rng.choice(WORDS, n))


def odd_table(spark):
    """Nulls in every column, empty and long texts, copies, near copies, repeated rows, clashing names."""
    base = [sentence(80) for _ in range(8)]
    texts = [None, "", " \t\n", "Ａ b", "one two", *base, base[0], base[0], base[1] + " x", base[1].upper(), sentence(20_000), "a " * 3000]
    rows = [(i, t, "en" if i % 2 else None, [None, "b", "a", "ä"][i % 4], None, 0.5, "k", 1, 2, 3) for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (None, base[2], None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, ROWS)


def empty(spark):
    return spark.createDataFrame([], ROWS)


def tokens_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


# -- language model


def book(texts):
    """Katz back-off of order three by the book: (probability of w after (t, u), counts of each order)."""
    counts = [collections.Counter() for _ in range(3)]
    for t in texts:
        line = ["<s>", "<s>", *t]
        for i in range(2, len(line)):
            for k in range(3):
                counts[k][tuple(line[i - k : i + 1])] += 1
    d = [katz.discounts([0] + [collections.Counter(c.values())[r] for r in range(1, katz.CUTOFF + 2)]) for c in counts]
    cut = lambda k, x: x * (d[k][x] if x <= katz.CUTOFF else 1)
    n = sum(counts[0].values())
    left = n - sum(cut(0, x) for x in counts[0].values())
    after = [collections.defaultdict(dict) for _ in range(3)]
    for k in (1, 2):
        for g, x in counts[k].items():
            after[k][g[:-1]][g[-1]] = x

    def prob(context, w):
        k = len(context)
        if not k:
            if not n:
                return 1.0
            if (w,) in counts[0]:
                return cut(0, counts[0][w,]) / n * (1 if left > 0 else n / (n + 1))
            return left / n if left > 0 else 1 / (n + 1)
        seen = after[k].get(context)
        if not seen:
            return prob(context[1:], w)
        total = sum(seen.values()) + (min(seen.values()) > katz.CUTOFF)
        if w in seen:
            return cut(k, seen[w]) / total
        if context not in weights:
            weights[context] = (1 - sum(cut(k, x) for x in seen.values()) / total) / (1 - sum(prob(context[1:], v) for v in seen))
        return weights[context] * prob(context[1:], w)

    weights = {}
    return prob, counts, after


@pytest.mark.parametrize("settings", [{}, {"hot_words": 0, "part_tokens": 900, "block_tokens": 700, "hot_share": 0.02}, {"hot_words": 40, "part_tokens": 900, "block_tokens": 300, "hot_share": 0.02}])
def test_katz_is_the_model_by_the_book(spark, settings):
    """With one part and without contexts on the list, and with many parts and many such contexts."""
    few = [" ".join(rng.choice(WORDS[:12], 30)) for _ in range(60)]  # contexts after which every word was seen
    docs = odd_table(spark).unionByName(spark.createDataFrame([(1000 + i, t, *[None] * 8) for i, t in enumerate(few)] + [(1100 + i, "all right", *[None] * 8) for i in range(40)], ROWS))
    rows = [(r.doc_id, [*tokens_of(r.text), "\n"]) for r in docs.collect()]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    prob, counts, after = book([t for i, t in rows if not out(i)])
    c, n = counts[0], sum(counts[0].values())
    contexts = [*list(after[2])[:25], *list(after[1])[:25], ("\n", "all"), ("all",), ("<s>", "<s>"), ("<s>",), ()]
    for x in contexts:
        assert abs(sum(prob(x, w) for (w,) in c) + prob(x, "never seen") - 1) < 1e-9
    want = []
    for i, t in rows:
        line = ["<s>", "<s>", *t]
        s = sum(math.log10(prob(tuple(line[j - 2 : j]), line[j])) for j in range(2, len(line)))
        base = sum(math.log10((c[w,] + 0.1) / (n + 0.1 * (len(c) + 1))) for w in t)
        want.append((str(i), out(i), len(t), sum((w,) in c for w in t), n, round(base, 5), round(s, 5)))
    got = [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 5)) for r in katz.score(docs, **settings).collect()]
    assert sorted(got) == sorted(want)


def test_katz_without_rows_and_without_training_rows(spark):
    assert katz.score(empty(spark)).count() == 0
    held = odd_table(spark).where("crc32(cast(doc_id as string)) % 10 = 0")
    got = katz.score(held).collect()
    assert got and all(r.held_out and r.score == 0 and r.n_known == 0 and r.train_tokens == 0 for r in got)


def test_words_are_cut_and_hashed_by_their_bytes(monkeypatch):
    monkeypatch.setattr(katz, "_PIECE", 64)
    texts = ["", " ", "Ab ab  AB\tx", "é\x0bÉ \x1c\u00a0x " + "long" * 100, sentence(300), "", "ab", "x" * 500 + " ab"]
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([7, *map(len, raw)])
    h, n = katz.words_of(np.frombuffer(b"before " + b"".join(raw) + b"after", np.uint8), offsets)
    want = [w for t in texts for w in tokens_of(t)]
    assert n.tolist() == [len(tokens_of(t)) for t in texts] and len(h) == len(want)
    assert len(set(h.tolist())) == len(set(want)) == len(set(zip(h.tolist(), want))) and h.min() > katz.END


# -- archives


def test_archives_round_trip(spark):
    a, b = "a" * 150, "é" * 60
    rows = [(1, "u1", a), (2, "u\r\n2", a), (3, None, "short"), (4, "u", "short"), (5, "u5", None), (None, "n", a), (6, "x", b), (7, "x", b), (7, "x", b), (1, "u1", a), (8, "long", "z " * 200_000)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    path = scratch(spark, "warc-test")
    warc.write_archives(pages.repartition(3), path)
    got = sorted((str(r.page_id), r.record_type, r.payload_bytes, r.refers_to, r.payload_digest) for r in warc.resolved(warc.read_archives(spark, path)).collect())
    first = {a: 1, b: 6}
    want = []
    for i, _, t in rows:
        t = t or ""
        again = t in first and first[t] != i
        want.append((str(i), "revisit" if again else "response", len(t.encode()), first[t] if again else None, hashlib.sha256(t.encode()).hexdigest()))
    assert got == sorted(want, key=lambda r: r[:3])
    none = scratch(spark, "warc-none")
    warc.write_archives(pages.limit(0), none)
    assert warc.read_archives(spark, none).count() == 0


def test_broken_archives_are_refused():
    records = [warc.record("response", i, f"u{i}", hashlib.sha256(p).hexdigest(), p) for i, p in enumerate([b"", b"x" * 500, b"\r\n\r\n"])]
    whole = b"".join(warc.archives(records))
    assert list(warc.frames(whole)) == records and [warc.parse(r)[1] for r in records] == [b"", b"x" * 500, b"\r\n\r\n"]
    sep = warc.SEPARATOR
    assert list(warc.frames(whole + sep)) == records
    for bad in (b"", whole[8:], whole[:-3], whole + b"x", whole[:-20] + b"0" * 20, whole + sep[:-1]):
        with pytest.raises(warc.WarcError):
            list(warc.frames(bad))
    for bad in (b"WARC/0.9\r\n\r\n", records[1][:-1], records[1].replace(b"Content-Length: ", b"Content-Length: 1"), records[1].replace(b"WARC-Date", b"WARC-Day"), records[1].replace(b"HTTP/1.1", b"HTTQ/1.1")):
        with pytest.raises(warc.WarcError):
            warc.parse(bad)


def test_archives_are_bounded_and_read_in_one_pass():
    import time

    pages = [np.random.default_rng(i).integers(0, 256, 60_000, dtype=np.uint8).tobytes() for i in range(1700)]  # these do not compress
    records = [warc.record("response", i, f"u{i}", hashlib.sha256(p).hexdigest(), p) for i, p in enumerate(pages)]

    def seconds(n):
        [a] = warc.archives(records[:n], 2**40)
        began = time.process_time()
        assert sum(1 for _ in warc.frames(a)) == n
        return len(a), time.process_time() - began

    (small, quick), (large, slow) = seconds(170), seconds(1700)
    assert large > 9 * small > 5e7 and large > 1e8 and slow < 30 * quick + 1
    cut = list(warc.archives(records, 5_000_000))
    assert len(cut) > 10 and all(len(a) < 5_000_000 + warc.TRAIN_BYTES + 100_000 for a in cut)
    assert [r for a in cut for r in warc.frames(a)] == records
    assert list(warc.archives([])) == []


def test_archives_without_broadcast(spark, sf, duck):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        same(warc.op2_warc(spark, sf), duck, warc.oracle())
        pages = spark.createDataFrame([(i, "u", "x" * 9000 + str(i // 2)) for i in range(1500)], "page_id long, url string, html string")
        path = scratch(spark, "warc-small")
        warc.write_archives(pages.coalesce(1), path, 5_000)
        sizes = [r.length for r in spark.read.format("binaryFile").load(path).select("length").collect()]
        assert len(sizes) == 4 and warc.resolved(warc.read_archives(spark, path)).where("record_type = 'revisit'").count() == 750
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


# -- quality


def test_quality_learns_and_keeps(spark):
    good = [sentence(60) + "." for _ in range(60)]
    bad = [" ".join([w] * 20) + " " + sentence(10).upper() + "!!" for w in WORDS[:40]]
    rows = [(i, t, "en", "s", 0, None, None, None, None, None) for i, t in enumerate(good + bad)]
    docs = spark.createDataFrame([*rows, rows[0], (None, "x", *[None] * 8), (500, None, *[None] * 8)], ROWS)
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(100)] + [(0, 1), (None, 0), (1, None), (2, 7)], "doc_id long, quality int")
    got = bt.score_documents(docs, labels).collect()
    assert len(got) == 103 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out]
    assert held and all(r.predicted == int(r.doc_id < 60) for r in held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert bt.score_documents(docs, labels.where("quality = 1")).where("predicted = 0").count() == 0
    assert bt.score_documents(empty(spark), labels).count() == 0
    # an id with two texts, a very long text: the same fit in any order of rows
    more = docs.union(spark.createDataFrame([(3, bad[0], *[None] * 8), (70, good[0], *[None] * 8), (600, sentence(200_000), *[None] * 8)], ROWS))
    key = lambda x: sorted((str(r.doc_id), r.score) for r in x.collect())
    assert key(bt.score_documents(more, labels)) == key(bt.score_documents(more.orderBy("text").repartition(3), labels.repartition(2)))


def test_quality_weights_minimise_the_logistic_loss_of_pairs():
    """The model against a loss and a score of another hand."""
    x = np.array([bt.features(sentence(40)) for _ in range(60)] + [bt.features(sentence(8).upper() + " a a a a") for _ in range(40)])
    y = np.array([1] * 60 + [0] * 40)
    m = bt.fit(x, y, pairs=500)
    r = np.random.default_rng(0)  # the pairs that the fit draws
    a, b = r.choice(np.flatnonzero(y == 1), 500), np.resize(r.permutation(np.flatnonzero(y == 0)), 500)

    def strength(w, row):
        out, base = 0.0, 0
        for value, edges in zip(row, m.edges):
            out += w[base + sum(e <= value for e in edges)]
            base += len(edges) + 1
        return out

    def loss(w):
        s = [strength(w, row) for row in x]
        return sum(math.log1p(math.exp(-(s[i] - s[j]))) for i, j in zip(a, b)) + bt.RIDGE / 2 * float(w @ w)

    best = loss(m.weights)
    for _ in range(6):
        step = r.normal(size=len(m.weights))
        assert loss(m.weights + 0.05 * step / np.linalg.norm(step)) > best
    s = np.array([strength(m.weights, row) for row in x])
    assert abs(m.threshold - np.quantile(s, 0.4)) < 1e-9
    z = m.slope * (s - m.threshold) + math.log(0.3 / 0.7)
    assert np.allclose(m.score(x), 1 / (1 + np.exp(-z)))


def test_quality_query_is_the_model_and_right_on_held_out_labels(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = bt.train(docs, labels)
    got = {r.doc_id: r for r in bt.op3_bradley_terry(spark, sf).collect()}
    for r in docs.collect():
        assert abs(got[r.doc_id].score - float(model.score(np.array([bt.features(r.text or "")]))[0])) < 1e-12
    held = [(got[r.doc_id].predicted, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert held and np.mean([p == q for p, q in held]) >= 0.9


# -- sketches


def sketch_by_hand(text):
    """Hashes of the five-word shingles below an eighth of the range, or the smallest one: XXH64 as Spark chains it."""
    w = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in tokens_of(text)]
    if not w:
        return ()
    out = set()
    for i in range(max(1, len(w) - 4)):
        h = 42
        for x in w[i : i + 5]:
            h = xxhash.xxh64_intdigest(x.to_bytes(8, "little"), seed=h)
        out.add(h)
    return tuple(sorted(h for h in out if h < 2**61)) or (min(out),)


def alike(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0


@pytest.mark.parametrize(("heavy", "bucket", "few"), [(100_000, 2048, 1_000_000), (1, 3, 1_000_000), (1, 3, 0)])
def test_sketches_by_hand(spark, monkeypatch, heavy, bucket, few):
    monkeypatch.setattr(sketch, "BROADCAST_HEAVY", few)
    docs = odd_table(spark)
    signed = lambda t: (lambda h: h - 2**64 if h >> 63 else h)(xxhash.xxh64_intdigest((t or "").encode(), seed=42))
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is None, -(r.doc_id or 0), -signed(r.text)))
    want = []
    for r, n in zip(rows, [*rows[1:], rows[0]]):
        t, nxt = r.text or "", n.text or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        own, changed, other = map(sketch_by_hand, (t, edited, nxt))
        hexed = lambda s: "".join(f"{h:016x}" for h in s)
        want.append((str(r.doc_id), len(t), hashlib.sha256(edited.encode()).hexdigest(), hexed(own), hexed(changed), round(alike(own, changed), 12), round(alike(own, other), 12)))
    got = [(str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 12), round(r.near_next, 12)) for r in sketch.fingerprints(docs, heavy=heavy, rows_per_bucket=bucket).collect()]
    assert sorted(got) == sorted(want)
    assert sketch.fingerprints(docs.where("doc_id = 5")).first().near_next == 1.0
    assert sketch.fingerprints(empty(spark)).count() == 0


def test_null_ids_have_buckets_of_their_own(spark):
    rows = [(None if i % 3 else i, f"text {i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "xxhash64(text) h")
    x = sketch.with_next(docs, {"text": "nxt"}, rows_per_bucket=20)
    order = sorted(docs.collect(), key=lambda r: (r.doc_id is None, -(r.doc_id or 0), -r.h))
    assert {(r.text, r.nxt) for r in x.collect()} == {(a.text, b.text) for a, b in zip(order, [*order[1:], order[0]])}


def test_sketches_merge_and_contain(spark):
    from pyspark.sql import functions as F

    a, b = sentence(3000), sentence(50)
    x = spark.createDataFrame([(a, b, a + " | | | | | " + b)], "a string, b string, ab string")
    for c in ("a", "b", "ab"):
        x = sketch.with_sketch(x, c, f"s{c}")
    r = x.select(sketch.containment(F.col("sb"), F.col("sab")).alias("c"), sketch.likeness(F.col("sa"), F.col("sab")).alias("j"), sketch.merge(F.col("sa"), F.col("sb")).alias("m"), "sab").first()
    assert r.c == 1.0 and r.j > 0.9 and set(r.m) <= set(r.sab)


# -- simhash


@pytest.mark.parametrize("crowd", [64, 2])
def test_simhash_by_hand(spark, monkeypatch, crowd):
    monkeypatch.setattr(sim, "PAIRED_CELL", crowd)
    docs = odd_table(spark)
    fp = {}
    for r in docs.collect():
        w = tokens_of(r.text)
        runs = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in runs]
        fp[r.doc_id] = sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))
    ids = sorted(i for i in fp if i is not None)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and (fp[i] ^ fp[j]).bit_count() <= 2:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    got = sim.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is not None:
            assert (r.fp & (2**64 - 1), r.component_id) == (fp[r.doc_id], find(r.doc_id))
    assert sim.near_duplicates(empty(spark)).count() == 0


# -- mixing


def test_mixing_meets_targets_exactly(spark):
    docs = odd_table(spark)
    got = mixing.mix(docs, slice_rows=3)
    again = mixing.mix(docs.repartition(3), slice_rows=50)
    key = lambda x: sorted(map(repr, x.collect()))
    assert key(got) == key(again)
    by = collections.defaultdict(int)
    size = {}
    for r in got.collect():
        assert 0 <= r.taken <= 2 * r.size
        by[r.source_size, r.target] += r.taken
        size[r.source_size, r.target] = r.source_size
    assert all(abs(taken - target) <= 0.5 for (_, target), taken in by.items())
    assert abs(sum(t for _, t in by) - 1.5 * sum(size.values())) < 1e-6
    assert mixing.mix(empty(spark)).count() == 0
    rows = mixing.mixed_rows(docs)
    assert rows.columns == docs.columns and 0 < rows.count()


def test_mixing_of_many_alike_rows_cuts_within_them(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 7)
    rows = [(None, "three words here", "x")] * 40 + [(1, "one", "y")] * 3 + [(2, "two words", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    for source_size in (120, 5):
        own = [r for r in got if r.source_size == source_size]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.5


def test_mixed_rows_stand_for_themselves(spark):
    """Rows of one id in two sources or with two texts, or without an id, all have their own copies."""
    rows = [(i % 50, sentence(5 + i % 7), "en", "abc"[i % 3], i) for i in range(300)]
    rows += [(1, "the same text here", "en", s, 7) for s in ("a", "b", None)] + [(None, "the same text here", None, "b", None), (1, "another text", "en", "a", 7)] * 4
    rows += [(i, None, None, "no words", None) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _copies long")
    got = mixing.mixed_rows(docs, slice_rows=8).collect()
    have, want = collections.Counter(map(tuple, rows)), collections.Counter(map(tuple, got))
    assert set(want) <= set(have) and all(want[r] <= 2 * have[r] for r in want)
    plan = {r.source if not r.no_source else None: r for r in mixing.cuts(mixing.narrow(docs, "mix")).collect()}
    longest = 12
    for s, p in plan.items():
        words = sum(len(tokens_of(r.text)) for r in got if r.source == s)
        assert abs(words - p.target) <= longest / 2 + 0.5
    again = mixing.mixed_rows(docs.repartition(3), slice_rows=50).collect()
    assert collections.Counter(map(tuple, again)) == want
    assert mixing.mixed_rows(docs.limit(0)).count() == 0


# -- licences


@pytest.fixture(scope="module")
def licence_model():
    plain = [lic.words(sentence(n)) for n in (4, 12, 40) for _ in range(100)]
    return lic.fit([[x if x in lic.weights_of_words() else "" for x in u] for u in plain])


#: Lines of licences that the templates do not have, and lines that use their words for other things.
OTHERS = ["The Software is licensed under the Boost Software License, Version 1.0.", "Licensed under the EUPL, Version 1.2.", "This program is made available under the terms of the Eclipse Public License 2.0.", "SPDX-License-Identifier: CDDL-1.0", "Licensed under the Artistic License 2.0"]
PLAIN = ["the license plate of the car was published", "general notice: work on the road", "He needs a driving license.", "the author reserved a table for the group", "It works under general conditions of the public road"]


def test_licences(spark, licence_model):
    model = licence_model
    cases = [("MIT", "Released under the MIT License."), ("Apache-2.0", "(c) x. Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file"), ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."), ("CC-BY-NC", "Licensed under CC BY-NC 4.0."), ("CC-BY", "Licensed under CC BY 4.0."), ("Proprietary", "All rights reserved."), ("GPL-3.0", "Subject to the GPL v3.")]
    cases += [("unknown", x) for x in OTHERS] + [("", x) for x in PLAIN] + [("", sentence(12)) for _ in range(100)]
    docs = spark.createDataFrame([(i, t, "x", 0.5) for i, (_, t) in enumerate(cases)], "doc_id long, text string, families string, probability double")
    got = {r.doc_id: (r.families or ("unknown" if r.n_unknown else "")) for r in lic.scan(docs, model).collect()}
    assert [got[i] for i in range(len(cases))] == [f for f, _ in cases]
    odd = [(1, "intro\nReleased under the MIT License.\nAll rights reserved."), (2, None), (3, ""), (4, " \t\n\n "), (None, "Licensed under CC BY 4.0."), (1, "intro\nReleased under the MIT License.\nAll rights reserved.")]
    long = "\n".join([sentence(30)] * 3000 + ["Licensed under CC BY 4.0."]) + "\n\n" + sentence(30_000) + " Released under the MIT License. " + sentence(300)
    docs = spark.createDataFrame([(*r, "MIT", 1.0) for r in [*odd, (5, long)]], "doc_id long, text string, families string, n_paragraphs double")
    out = {(r.doc_id, r.n_paragraphs, r.families, r.n_licensed) for r in lic.scan(docs, model).collect()}
    assert out == {(1, 3, "MIT,Proprietary", 2), (2, 0, "", 0), (3, 0, "", 0), (4, 0, "", 0), (None, 1, "CC-BY", 1), (5, 3002, "CC-BY,MIT", 2)}
    assert lic.scan(docs.limit(0), lic.train(docs.limit(0))).count() == 0


def test_wrapped_licences_are_found(spark, licence_model):
    mit = [t for t in lic.TEMPLATES["MIT"] if t.startswith("Permission")][0]
    gpl = [t for t in lic.TEMPLATES["GPL-3.0"] if t.startswith("This program")][0]
    bsd = [t for t in lic.TEMPLATES["BSD"] if t.startswith("Redistribution")][0]
    wrap = lambda t, mark="": "\n".join(mark + x for x in textwrap.wrap(t, 68))
    texts = ["code\n\n" + wrap(mit) + "\n\nmore", wrap(gpl, " * "), wrap(bsd, "# "), wrap(sentence(90)), "one\n\n" + wrap("the road and the car of the group were there at nine " * 6), sentence(100) + " " + gpl + " " + sentence(100)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.families for r in lic.scan(docs, licence_model).collect()}
    assert got == {0: "MIT", 1: "GPL-3.0", 2: "BSD", 3: "", 4: "", 5: "GPL-3.0"}


def brute_licences(model, text):
    """The same result, unit by unit: every line of up to UNIT words and every window, without a filter."""
    number, pairs = lic.vocabulary()
    pair_at = {p: len(number) + i for i, p in enumerate(pairs.tolist())}

    def judged(unit, around):
        f = {number[w] for w in unit if w in number} | {pair_at[k] for a, b in zip(unit, unit[1:]) if a in number and b in number for k in [number[a] * len(number) + number[b]] if k in pair_at}
        return f, around

    units = []
    for b, block in enumerate(re.split(r"\n(?:[^\S\n]*\n)+", text)):
        lines = [lic.words(x) for x in block.split("\n")]
        flat = [w for x in lines for w in x]
        for x, w in enumerate(lines):
            if 0 < len(w) <= lic.UNIT:
                units.append((b, x, judged(w, w), len(w)))
        if sum(map(bool, lines)) > 1 or len(flat) > lic.UNIT:
            starts = list(range(0, len(flat), lic.STEP))
            for s in starts if len(starts) == 1 else starts[:-1]:
                w = flat[s : s + lic.UNIT]
                f, _ = judged(w, w)
                if s:  # a 2-gram stands where it ends
                    f |= judged(flat[s - 1 : s + 1], ())[0] - judged(flat[s - 1 : s], ())[0]
                units.append((b, -1, (f, flat[max(0, s - lic.UNIT) : s + 2 * lic.UNIT]), len(w)))
    out = []
    for b, x, (f, around), n in units:
        z = (sum((model.weights[i] for i in f), np.zeros(lic.CLASSES)) / np.sqrt(n) + model.weights[-1]) / model.temperature
        q = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        out += [(b, x, f) for f in lic.judge(model, q, around)]
    return out


def confirmed_by_hand(line):
    """Families whose templates' words a line holds in order, by a plain table of the longest common subsequence."""
    text, out = lic.words(line), {}
    used = {w: sum(any(w in lic.words(t) for t in ts) for ts in lic.TEMPLATES.values()) for ts in lic.TEMPLATES.values() for t in ts for w in lic.words(t)}
    value = lambda w: math.log1p(len(lic.TEMPLATES) / used[w])
    for f, ts in lic.TEMPLATES.items():
        for t in ts:
            w = lic.words(t)
            best = [[(0.0, ())] * (len(w) + 1) for _ in range(len(text) + 1)]
            for i, a in enumerate(text):
                for j, b in enumerate(w):
                    best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], *([(best[i][j][0] + value(b), (*best[i][j][1], j))] if a == b else []), key=lambda x: x[0])
            total, taken = best[-1][-1]
            names = [j for j, b in enumerate(w) if used[b] == min(used[x] for x in w)]
            if total >= 0.7 * sum(map(value, w)) and sum(j in taken for j in names) >= 0.7 * len(names):
                out[f] = max(out.get(f, 0.0), total)
    return out


def test_every_confirmed_family_of_a_line_is_found(spark, licence_model):
    several = {
        "Licensed under the MIT License or the Apache License, Version 2.0.": "Apache-2.0,MIT",
        "SPDX-License-Identifier: MIT OR Apache-2.0": "Apache-2.0,MIT",
        "SPDX-License-Identifier: MIT OR Apache-2.0 OR ISC OR BSD-3-Clause OR MPL-2.0 OR Unlicense": "Apache-2.0,BSD,ISC,MIT,MPL-2.0,Unlicense",
        "Licensed under CC BY-SA 4.0.": "CC-BY-SA",
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC",
        "Licensed under CC BY 4.0.": "CC-BY",
        "Licensed under CC BY-NC-SA 4.0.": "",
        "Licensed under CC BY-NC-ND 4.0.": "",
        "Licensed under the GPL v2. Licensed under the GPL v3.": "GPL-2.0,GPL-3.0",
    }
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(several)], "doc_id long, text string")
    got = {r.doc_id: r for r in lic.scan(docs, licence_model).collect()}
    assert [got[i].families for i in range(len(several))] == list(several.values())
    assert all(r.n_licensed == (1 if r.families else 0) and (not r.families or r.probability > 0.5) for r in got.values())
    for i, t in enumerate(several):
        assert set(filter(None, got[i].families.split(","))) <= set(confirmed_by_hand(t))
    for f, ts in lic.TEMPLATES.items():
        for t in ts:
            found = {lic.FAMILIES[k]: m for k in range(lic.UNKNOWN) if (m := lic.resemblance(lic.words(t), k))}
            by_hand = confirmed_by_hand(t)
            # a name that goes on with another's is left out
            assert f in found and set(found) <= set(by_hand) and all(abs(m.weight - by_hand[k]) < 1e-6 or m.share == 1.0 for k, m in found.items())


def test_licence_scan_is_that_of_all_units(licence_model):
    pieces = [*(t for ts in lic.TEMPLATES.values() for t in ts), *OTHERS, *PLAIN]
    texts = []
    for i in range(120):
        own = [str(rng.choice(pieces)) if rng.random() < 0.3 else sentence(int(rng.integers(1, 90))) for _ in range(int(rng.integers(0, 12)))]
        texts.append("".join(x + str(rng.choice(["\n", "\n\n", " ", "\n \t\n", "\n# "])) for x in own))
    got = lic.scan_texts(licence_model, texts)
    for t, g in zip(texts, got):
        want = brute_licences(licence_model, t)
        assert sorted((f.family, round(f.probability, 9), round(f.confirmation, 9), x < 0) for _, x, f in g) == sorted((f.family, round(f.probability, 9), round(f.confirmation, 9), x < 0) for _, x, f in want)
        assert lic.summary(g)[:3] == lic.summary(want)[:3]


def test_licence_query_finds_the_planted_lines(spark, sf):
    """Precision and recall over all documents against whole lines of the templates."""
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    known = {" ".join(lic.words(t)): f for f, ts in lic.TEMPLATES.items() for t in ts}
    want = {i: {known[k] for x in t.split("\n") for k in [" ".join(lic.words(x))] if k in known} for i, t in docs.items()}
    got = {r.doc_id: (set(filter(None, r.families.split(","))), r.n_unknown) for r in lic.op9_licence(spark, sf).collect()}
    assert sum(map(len, want.values())) >= 3 and all(want[i] == got[i][0] for i in docs) and sum(n for _, n in got.values()) <= 1


# -- registered queries


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_is_what_sql_gives(spark, sf, duck, name):
    same(registry.queries()[name](spark, sf), duck, registry.oracle_sql()[name])


def test_one_query_for_each_operator():
    names = registry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names
