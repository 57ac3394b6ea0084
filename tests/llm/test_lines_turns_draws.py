import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import pytest

from pagemill.llm import op11_line_runs as lines
from pagemill.llm import op12_conversations as turns
from pagemill.llm import op13_importance as draws
from pagemill.llm.common import scratch

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = " \t\n\x0b\f\r"

# -- line dedup


def lines_by_hand(rows, least=40, many=5):
    key = lambda x: x.strip(SPACE).translate(LOWER)
    held = defaultdict(list)
    for i, (doc, text) in enumerate(rows):
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= least:
                held[k].append((i, doc))
    out = []
    for doc, text in rows:
        own = (text or "").split("\n")
        kept = []
        for x in own:
            holders = held.get(key(x), [])
            top = max((d for _, d in holders if d is not None), default=None)
            if len(holders) < many or top is None or doc == top:
                kept.append(x)
        out.append((doc, len(own), len(own) - len(kept), "\n".join(kept)))
    return sorted(map(repr, out))


def document_rows(n=120, seed=3):
    r = random.Random(seed)
    common = ["Ärger " + "x" * 40, "y" * 39 + "Z", "y" * 38 + "É", "short", "", "q" * 50, " \t" + "Q" * 50 + "\r", "p" * 60]
    rows = []
    for i in range(n):
        own = [r.choice(common) if r.random() < 0.6 else f"line {r.random()} " + "w" * 40 for _ in range(r.randrange(0, 9))]
        rows.append((i, "\n".join(own)))
    rows += [(None, "p" * 60), (None, "n" * 60), (None, "n" * 60), (None, None), (5, None), (n - 1, "q" * 50)] + [rows[7]] * 9 + [(None, "n" * 60)] * 3
    rows.append((n, "\n".join(["q" * 50] * 500 + ["tail"])))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("batches", "fan", "share"), [(1, 2, 65536), (4, 2, 8), (7, 3, 4), (5, 9, 10**9)])
def test_lines_by_hand(spark, batches, fan, share):
    rows = document_rows()
    docs = spark.createDataFrame([(d, t, "a", "b", 1) for d, t in rows], "doc_id long, text string, key string, batch string, n int")
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in lines.dedup(docs, batches, fan, share=share).collect()]
    assert sorted(map(repr, got)) == lines_by_hand(rows)


def test_lines_of_an_empty_table(spark):
    assert lines.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_runs_are_levelled_taken_up_again_and_met_without_a_shuffle(spark):
    folder = scratch(spark, "runs")
    docs = lambda *ids: lines.line_keys(spark.createDataFrame([(i, "k" * 40 + f"\n{'u' * 40}{i % 3}") for i in ids], "doc_id long, text string"), lines.F.lit(0))
    runs = lines.Runs(spark, folder)
    for number, ids in enumerate(((9, 8), (7, 6), (5, 4), (3,), (2,))):
        runs.add(number, docs(*ids))
    assert sorted(runs.runs) == [(0, 4, 4), (2, 0, 3)]
    again = lines.Runs(spark, folder)
    again.add(2, docs(5, 4))  # it is there already
    assert again.runs == sorted(runs.runs) and again.buckets == runs.buckets
    got = {r.key: (r.n, r.keeper) for r in again.total().collect()}
    own = lambda x: hashlib.md5(x.encode()).digest()
    # five documents were enough: the last ones are not counted
    assert got == {own("k" * 40): (7, 9), own("u" * 40 + "0"): (3, 9), own("u" * 40 + "1"): (2, 7), own("u" * 40 + "2"): (3, 8)}
    plan = again.total()._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    again.close()


# -- conversations


def cheapest(rows):
    """The least (cost, edits) over all edits of rows (role, text, fault), and the repaired rows."""
    good = re.compile(r"(s?(ua)+)?")

    @lru_cache(None)
    def best(i, last, inserts):
        ends = []
        if i == len(rows):
            if last in "oa":
                ends.append((0, "", ()))
        else:
            role, text, fault = rows[i]
            late = 1 if fault == "truncated" else 0
            c, e, r = best(i + 1, last, 2)
            ends.append((c + 3, "D" + e, r))
            if fault not in ("blank", "duplicate"):
                for letter, cost, new in [("K", 0, role), ("R", 2, "user"), ("R", 2, "assistant")]:
                    if last + new[:1] in ("os", "ou", "su", "ua", "au"):
                        c, e, r = best(i + 1, new[:1], 2)
                        ends.append((c + cost + late, letter + e, ((new, text), *r)))
        for new in ("user", "assistant"):
            if inserts and last + new[0] in ("ou", "su", "ua", "au"):
                c, e, r = best(i, new[0], inserts - 1)
                ends.append((c + 2, "I" + e, ((new, ""), *r)))
        return min(ends, default=(10**9, "", ()))

    cost, edits, kept = best(0, "o", 2)
    assert good.fullmatch("".join(r[:1] for r, _ in kept))
    return cost, edits, kept


def conversation_by_hand(rows):
    """rows (turn, role, text) after damage, in order."""
    seen, faulty = set(), []
    for _, role, text in rows:
        bare = text.strip(SPACE)
        faulty.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    cost, edits, kept = cheapest(tuple((r, t, f) for (_, r, t), f in zip(rows, faulty)))
    known = [t for t, _, _ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
    return (gaps, *(faulty.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, edits, digest)


def damaged_by_hand(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out[conv] += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return {c: sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, x in out.items()}


@pytest.mark.parametrize("size", [2, 256])
def test_conversations_by_hand(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(turns, "ROWS", size)
    r = random.Random(size)
    texts = ["Yes.", "No!", "cut", " \t", "", None, "é?\n", "x" * 5000 + ".", "Yes."]
    rows = []
    for conv in [None, *range(60)]:
        n = r.choice([1, 2, 3, 4, 6, 9])
        for turn in range(n):
            at = r.choice([turn, turn, turn, None, 2 * turn])
            rows.append((conv, at, r.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None]), r.choice(texts + [f"t{turn}."] * 4)))
    rows += [rows[3]] * 4 + [(70, 1, "user", "alike.")] * 40
    path = str(tmp_path)
    spark.createDataFrame([(*x, 1, 2, "p") for x in rows], "conv_id long, turn long, role string, text string, place int, slice int, copies string").write.parquet(f"{path}/conversations.parquet")
    got = {x.conv_id: (x.gaps, x.blank, x.duplicate, x.truncated, x.illegal, x.cost, x.audit, x.repaired_sha256) for x in turns.op12_conversations(spark, path).collect()}
    want = {c: conversation_by_hand(x) for c, x in damaged_by_hand(rows).items()}
    assert got == want


def test_no_conversations(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert turns.op12_conversations(spark, str(tmp_path)).count() == 0


def test_a_conversation_that_loses_all_rows(spark, tmp_path):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    spark.createDataFrame([(conv, 0, "user", "gone.")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert turns.op12_conversations(spark, str(tmp_path)).collect() == [(conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


# -- importance


def draws_by_hand(docs, target, buckets=10000, percent=25):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        return w, [zlib.crc32(f.encode()) % buckets for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features(text)[1])
    for text in target:
        t.update(features(text)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for doc, text in docs:
        w, f = features(text)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    fit = sorted((x for x in out if x[5] >= 20), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    for i, x in enumerate(fit[: percent * len(fit) // 100]):
        x[4] = i + 1
    return sorted(repr(x[:5]) for x in out)


@pytest.mark.parametrize("with_target", [True, False])
def test_draws_by_hand(spark, with_target):
    r = random.Random(1)
    vocabulary = ["Alpha", "beta", "gÄmma", "d2", "épée", "文字", "x" * 300]
    docs = [(i, " -\n".join(r.choice(vocabulary) for _ in range(r.randrange(0, 60)))) for i in range(80)]
    docs += [(None, "beta " * 30), (None, "beta " * 30), (80, None), (81, ""), (82, " ?! "), (83, "one"), (84, "beta d2 " * 20000)] + [docs[5]] * 20 + [(85, "beta gÄmma " * 15)] * 20
    target = ["beta d2", None, "Alpha ALPHA épée"] if with_target else []
    got = draws.resample(spark.createDataFrame([(d, t, 1, "s") for d, t in docs], "doc_id long, text string, score int, row string"), spark.createDataFrame([(t, 1) for t in target], "text string, bucket int"))
    assert sorted(repr([x.doc_id, x.n_features, x.weight, x.score, x["rank"]]) for x in got.collect()) == draws_by_hand(docs, target)


def test_draws_from_an_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert draws.resample(none, none).count() == 0


def test_ranks_are_places_of_the_whole_order(spark):
    x = spark.range(1000).selectExpr("id % 7 AS score", "id AS row")
    got = draws.ranked(x, [draws.F.desc("score"), draws.F.asc("row")]).collect()
    assert [(r.score, r.row) for r in sorted(got, key=lambda r: r["rank"])] == sorted(((i % 7, i) for i in range(1000)), key=lambda p: (-p[0], p[1])) and {r["rank"] for r in got} == set(range(1, 1001))


def test_pipeline_stages_keep_columns_that_are_named_like_their_own(spark, sf):
    """Extra columns named like those that stages work with stay as they are, and change no decision."""
    import corpus_pipeline
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60")
    names = ["row", "i", "k", "no_id", "row_key", "text_key", "copies", "score", "_copy", "n_tokens", "slice", "no_source"]
    more = docs.select("*", *[F.concat(F.lit(f"{n}-"), F.col("doc_id").cast("string")).alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        want = sorted(r.doc_id for r in stage(spark, docs, sf).select("doc_id").collect())
        got = stage(spark, more, sf).collect()
        assert sorted(r.doc_id for r in got) == want, name
        assert all(r[n] == f"{n}-{r.doc_id}" for r in got for n in names), name
    _, bpe = corpus_pipeline.STAGES[-1]
    assert sorted(map(repr, bpe(spark, more, sf).collect())) == sorted(map(repr, bpe(spark, docs, sf).collect()))
