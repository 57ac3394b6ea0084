import hashlib
import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
os.environ["TOKENIZERS_PARALLELISM"] = "false"
from tokenizers import Tokenizer  # noqa: E402

from pagemill.llm import op7_chunked_bpe as bpe  # noqa: E402
from pagemill.llm import op10_digest_cache as cache  # noqa: E402
from pagemill.llm import tokens  # noqa: E402
from pagemill.llm.common import scratch  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)
ROWS = "doc_id long, text string, lang string, digest string, n_tokens string"


def ids(text):
    return LIB.encode(text, add_special_tokens=False).ids


def test_every_code_point_is_encoded_as_the_library_does():
    encode, _ = tokens.load(PATH)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)}1 {chr(c)}b  {chr(c)}.{chr(c)}{chr(c)} x" for c in points[i : i + 64]) for i in range(0, len(points), 64)]
    for text, got in zip(texts, LIB.encode_batch(texts, add_special_tokens=False)):
        assert encode(text) == got.ids


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200) | st.lists(st.sampled_from(["<|endoftext|>", " ", "\n", "don't", "'s", "é", "  x", "\t", "123", "!!"]), max_size=40).map("".join))
def test_texts_are_encoded_as_the_library_does(text):
    encode, pieces = tokens.load(PATH)
    assert encode(text) == ids(text)
    assert b"".join(pieces[i] for i in ids(text)).decode() == LIB.decode(ids(text), skip_special_tokens=False) == text


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["the quick brown fox ", "é ü ", "  ", "\n\n", "<|endoftext|>", "x" * 50, "don't 's ", "1234 ", "文字"]), min_size=1, max_size=200), st.integers(0, 2**32))
def test_chunks_put_together_are_the_whole(parts, seed):
    encode, pieces = tokens.load(PATH)
    lengths, raw = np.array([len(p) for p in pieces]), "".join(parts).encode()
    cut = bpe.chunks(raw)
    assert b"".join(raw[s:e] for s, e in cut) == raw
    rng = np.random.default_rng(seed)
    known = {i: encode(raw[s:e].decode()) for i, (s, e) in enumerate(cut) if rng.random() < 0.7}
    assert bpe.assemble(raw, known, encode, lengths) == ids(raw.decode())


def test_a_text_on_which_the_fast_one_fails_goes_to_the_library(monkeypatch):
    import tiktoken

    def fails(self, text, **_):
        raise ValueError(text)

    monkeypatch.setattr(tiktoken.Encoding, "encode", fails)
    encode, _ = tokens.load(PATH)
    assert encode("a text, 12 é") == ids("a text, 12 é")


def passages():
    """A passage of several chunks in scripts without and with spaces."""
    rng = np.random.default_rng(2)
    sign = lambda lo, hi, n: "".join(chr(c) for c in rng.integers(lo, hi, n))
    cjk = "".join(sign(0x4E00, 0x9000, int(rng.integers(4, 15))) + str(rng.choice(list("，。、：！？"))) for _ in range(600))
    cyrillic = " ".join(sign(0x430, 0x450, int(rng.integers(2, 9))) for _ in range(1500))
    hindi = " ".join(sign(0x905, 0x939, int(rng.integers(2, 9))) for _ in range(800))
    return {"cjk": cjk, "cyrillic": cyrillic, "hindi": hindi, "ascii": " ".join(str(rng.choice(["don't", "stop", "12,5", "'s", "x!"])) + sign(0x61, 0x7B, 3) for _ in range(1500))}


@pytest.mark.parametrize("script", ["cjk", "cyrillic", "hindi", "ascii"])
def test_chunks_of_any_script_are_reused(script):
    """A shared passage in another text is taken from its chunks, but for the joins."""
    encode, pieces = tokens.load(PATH)
    lengths, passage = np.array([len(p) for p in pieces]), passages()[script]
    raw = ("文 another start 1" + passage + "'re the end").encode()
    once = {passage.encode()[s:e] for s, e in bpe.chunks(passage.encode())}
    cut = bpe.chunks(raw)
    known = {i: encode(raw[s:e].decode()) for i, (s, e) in enumerate(cut) if raw[s:e] in once}
    size = []

    def counted(text):
        size.append(len(text.encode()))
        return encode(text)

    assert bpe.assemble(raw, known, counted, lengths) == ids(raw.decode())
    assert len(known) >= 3 and sum(size) < 0.6 * len(raw)


def test_joins_are_drawn_on_until_they_agree():
    """Ids of a chunk that are not those of the text are not taken over."""
    encode, pieces = tokens.load(PATH)
    lengths = np.array([len(p) for p in pieces])
    chunk, before = b"one, two, three, four, five, six, seven", b"start "
    own = encode(chunk.decode())
    ends = np.cumsum(lengths[own]).tolist()
    head, first = bpe.joined(before, chunk, own, ends, encode, bpe.last_place(chunk.decode()))
    assert first == 3 and head == ids("start one")
    wrong = [own[0], *own[1:3][::-1], *own[3:]] if len(pieces[own[1]]) != len(pieces[own[2]]) else own
    ends = np.cumsum(lengths[wrong]).tolist()
    got = bpe.joined(before, chunk, wrong, ends, encode, bpe.last_place(chunk.decode()))
    assert wrong == own or got is None or got[1] > first
    assert bpe.joined(before, b"letters", encode("letters"), [7], encode, -1) is None


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.lists(st.sampled_from(["'", "s", "re", " ", "\n", "x", "1", "!", "é", "文", "\u0301", "\x1c", "\u2003", "."]), max_size=30).map("".join))
def test_places_split_whatever_stands_around(text):
    encode, _ = tokens.load(PATH)
    raw = text.encode()
    for p in bpe.places(text):
        assert encode(raw[:p].decode()) + encode(raw[p:].decode()) == ids(text) or tokens.SPECIAL in text
    assert bpe.last_place(text) == max(bpe.places(text), default=-1)


def test_chunks_follow_content():
    rng = np.random.default_rng(0)
    passage = rng.integers(97, 123, 20_000, dtype=np.uint8).tobytes()
    a = {passage[s:e] for s, e in bpe.chunks(passage)}
    b = b"another start of a text. " + passage
    assert len(a & {b[s:e] for s, e in bpe.chunks(b)}) > 0.8 * len(a)
    assert bpe.chunks(b"") == [] and max(e - s for s, e in bpe.chunks(b"a" * 5000)) <= 5000


def table(spark):
    long = "word " * 60_000
    shared = "a passage that many documents hold, word for word. " * 40
    texts = [None, "", " \n", "plain", "plain", "é😀 <|endoftext|> x", long, long, "first " + shared + "end", "second\n\n" + shared, shared * 3]
    return spark.createDataFrame([(i if i != 3 else None, t, "en", "x", "y") for i, t in enumerate(texts)] + [(4, "plain", "en", "x", "y")], ROWS)


@pytest.mark.parametrize("bits", [2**28, 0])
def test_encoding_of_documents(spark, bits):
    """With a filter, and without one where it would be too large."""
    docs = table(spark)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_documents(docs, PATH, bits).collect())
    want = []
    for r in docs.collect():
        t = ids(r.text or "")
        want.append((r.doc_id if r.doc_id is not None else -1, len(t), hashlib.sha256(",".join(map(str, t)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert got == sorted(want)


def test_counts_and_cache(spark, monkeypatch):
    docs, path = table(spark), scratch(spark, "cache")
    want = sorted((r.doc_id if r.doc_id is not None else -1, len((r.text or "").encode()), len(ids(r.text or ""))) for r in docs.collect())
    for _ in range(2):
        got = cache.count_tokens(docs, PATH, path)
        assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens) for r in got.collect()) == want
        assert all(r.over_limit == (r.n_tokens > 1024) for r in got.collect())
        stored = spark.read.schema(cache.CACHE_SCHEMA).parquet(path)
        assert stored.count() == docs.selectExpr("coalesce(text, '') t").distinct().count()  # misses alone were appended
    # a cache that lacks some texts counts these alone, by broadcast or shuffle
    more = docs.unionByName(spark.createDataFrame([(90 + i, f"text {i % 3}", "en", "x", "y") for i in range(6)], ROWS))
    for limit, extra in ((0, "a"), (10, "b")):
        monkeypatch.setattr(cache, "BROADCAST_MISSES", limit)
        x = more.withColumn("text", F.when(F.col("doc_id") >= 90, F.concat("text", F.lit(extra))).otherwise(F.col("text")))
        before = spark.read.schema(cache.CACHE_SCHEMA).parquet(path).count()
        assert cache.count_tokens(x, PATH, path).count() == more.count()
        assert spark.read.schema(cache.CACHE_SCHEMA).parquet(path).count() == before + 3
    # stored counts are used: another version's are not
    spark.createDataFrame([("other", b"x", 5)], cache.CACHE_SCHEMA).write.mode("append").parquet(path)
    assert cache.read_cache(spark, path, "other").count() == 1


def test_empty_tables(spark):
    none = spark.createDataFrame([], ROWS)
    assert bpe.encode_documents(none, PATH).count() == 0
    assert cache.count_tokens(none, PATH, scratch(spark, "cache")).count() == 0
