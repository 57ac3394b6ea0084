"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the last 32 bytes cuts texts where its top bits are zero, so
equal passages are cut alike in whatever text they stand. Chunks that occur
twice or more are encoded once; a text takes the ids of its shared chunks from
there and encodes what lies between.

Joins: a chunk alone is not encoded as it is inside a text, because the
pre-tokenizer may see a longer run across the cut. It splits, whatever stands
around, behind a letter, a number or a symbol (but an apostrophe) that something
of another kind follows, in any script; at such places, chunk and text agree.
A join is repaired by encoding the text from the last such place in what is
already encoded to one inside the chunk and on to the next one: the ids between
these two must be those that the chunk has there, else the join is drawn on to
the next place, until they agree or the chunk ends, which is then encoded with
the text. At its end a chunk's ids are taken up to its last such place. Kinds are
taken only of code points whose kind is the same in Unicode 3.2 and now, so that
libraries of different age see the same places. Texts with the special string
are encoded as a whole.

Which texts hold shared chunks is found out on the way: a Bloom filter over the
shared chunks' keys, BITS_EACH bits for each and MOST_BITS at most, goes to all
tasks. Texts without a hit are encoded in the scan. Others are shuffled once
each, whatever the number of their copies, to meet their shared chunks' ids. A
false hit costs a shuffle and changes no result. Where the filter would need
more than MOST_BITS, there is none: all texts are then shuffled once, and their
chunks' keys are joined to the shared ones.

Defined results: a null text is empty (no ids, the digest of nothing); a very
long text is one row throughout, its chunks like any other's; null ids and
repeated rows keep their rows; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import scratch, whole_text, written

#: Cut where so many top bits are zero: about one byte in 2**CUT_BITS.
CUT_BITS = 10
MIN_CHUNK = 256
#: Texts that a task holds decoded at a time.
SLICE = 1000
BITS_EACH, MOST_BITS = 16, 2**28


def _gear() -> np.ndarray:
    return np.frombuffer(b"".join(hashlib.sha256(bytes([b])).digest()[:4] for b in range(256)), np.uint32)


GEAR = _gear()


def chunks(raw: bytes, cut_bits: int = CUT_BITS, least: int = MIN_CHUNK) -> list[tuple[int, int]]:
    """(start, end) of each chunk; ends stand at code points."""
    a = np.frombuffer(raw, np.uint8)
    n = len(a)
    if n <= least:
        return [(0, n)] if n else []
    h = GEAR[a]
    for s in (1, 2, 4, 8, 16):
        h[s:] = h[s:] + (h[:-s] << np.uint32(s))
    out, start = [], 0
    for i in (np.flatnonzero(h >> np.uint32(32 - cut_bits) == 0) + 1).tolist():
        while i < n and a[i] & 0xC0 == 0x80:
            i += 1
        if i - start >= least and i < n:
            out.append((start, i))
            start = i
    return [*out, (start, n)]


def key(chunk: bytes) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(chunk)


LETTER, NUMBER, SYMBOL, SPACE = range(1, 5)


class _Kinds(dict):
    def __missing__(self, c: str) -> int:
        """The pre-tokenizer's kind of a code point, 0 where it may be another in other versions of Unicode."""
        now, then = unicodedata.category(c), unicodedata.ucd_3_2_0.category(c)
        if c in " \t\n\r":
            kind = SPACE
        elif now != then:
            kind = 0
        else:
            kind = {"L": LETTER, "N": NUMBER, "P": SYMBOL, "S": SYMBOL, "M": SYMBOL}.get(now[0], 0)
        self[c] = kind
        return kind


KINDS = _Kinds()


def splits(text: str, at: int) -> bool:
    """Whether the pre-tokenizer splits before text[at] whatever stands around these two code points."""
    left, right = KINDS[text[at - 1]], KINDS[text[at]]
    return left != right and 0 < left < SPACE and right > 0 and text[at - 1] != "'"


def places(text: str) -> Iterator[int]:
    """Bytes at which a chunk's text is split whatever stands around, from the left."""
    size = 0
    for i in range(1, len(text)):
        size += len(text[i - 1].encode())
        if splits(text, i):
            yield size


def last_place(text: str) -> int:
    """The last of `places`, -1 where there is none."""
    size = len(text.encode())
    for i in range(len(text) - 1, 0, -1):
        size -= len(text[i].encode())
        if splits(text, i):
            return size
    return -1


#: Bytes at least over which a repaired join must agree with the chunk's own ids.
AGREE = 8


def joined(before: bytes, chunk: bytes, ids: list[int], ends: list[int], encode: Callable[[str], list[int]], last: int) -> tuple[list[int], int] | None:
    """(ids of `before` and the chunk's beginning, the chunk's byte from which its own
    ids hold): the join is drawn on until the text's ids and the chunk's agree. ends:
    of the chunk's ids; last: its last place. None where they never do."""
    text = chunk.decode()
    place = places(text)
    first = next(place, None)
    while first is not None and first < last:
        second = next((p for p in place if p >= first + AGREE), None)
        if second is None or second > last:
            return None
        head, tail = encode((before + chunk[:first]).decode()), encode((before + chunk[:second]).decode())
        i, j = bisect_left(ends, first), bisect_left(ends, second)
        if ends[i] == first and ends[j] == second and tail == head + ids[i + 1 : j + 1]:
            return head, first
        first = second
    return None


def assemble(raw: bytes, known: dict[int, list[int]], encode: Callable[[str], list[int]], lengths: np.ndarray) -> list[int]:
    """Ids of a text from those of some of its chunks, by chunk number."""
    out: list[int] = []
    done = 0
    for i, (start, end) in enumerate(chunks(raw)):
        if i not in known:
            continue
        chunk, ids = raw[start:end], known[i]
        ends = np.cumsum(lengths[ids]).tolist()
        last = last_place(chunk.decode())
        if last < 1 or ends[-1] != len(chunk):
            continue
        k = bisect_left(ends, last)
        if ends[k] != last or not (got := joined(raw[done:start], chunk, ids, ends, encode, last)):
            continue
        head, first = got
        out += head
        out += ids[bisect_left(ends, first) + 1 : k + 1]
        done = start + last
    return out + encode(raw[done:].decode())


def _digests(ids: list[int], names: list[str], pieces: list[bytes]) -> tuple[int, str, str]:
    back = b"".join([pieces[i] for i in ids]).decode("utf-8", "replace")
    return len(ids), hashlib.sha256(",".join([names[i] for i in ids]).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


RESULT = "n_tokens long, ids_sha256 string, decoded_sha256 string"
_RESULT = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]


def _batch(columns: list, names: list[str], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*columns, *(pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(_RESULT))], [*names, *(n for n, _ in _RESULT)])


@dataclass(frozen=True)
class Bloom:
    """Bits as bytes; none at all: every key hits."""

    bits: np.ndarray | None

    def hit(self, k: bytes) -> bool:
        return self.bits is None or all(self.bits[p >> 3] >> (p & 7) & 1 for p in _places(k, 8 * len(self.bits)))


def _places(k: bytes, size: int) -> tuple[int, int]:
    return int.from_bytes(k[:8], "little") % size, int.from_bytes(k[8:], "little") % size


def bloom_filter(keys: DataFrame, each: int = BITS_EACH, most: int = MOST_BITS) -> Bloom:
    """A filter of `each` bits or more for a key; none where that is over `most`."""
    n = keys.count()
    if n * each > most:
        return Bloom(None)
    size = max(2**12, 1 << max(0, n * each - 1).bit_length())

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = np.array([x for k in b.column("key") for x in _places(k.as_py(), size)], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(p >> 6), pa.array(np.left_shift(np.uint64(1), (p & 63).astype(np.uint64)).view(np.int64))], ["at", "bits"])

    got = keys.mapInArrow(words, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(size // 64, np.int64)
    out[got.column("at").to_numpy()] = got.column("bits").to_numpy()
    return Bloom(out.view(np.uint8))


def encode_documents(docs: DataFrame, path: str, most_bits: int = MOST_BITS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", whole_text().alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c: Counter = Counter()
            for x in b.column("text"):
                raw = x.as_py().encode()
                c.update(key(raw[s:e]) for s, e in chunks(raw))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], ["key", "n"])

    shared = written(rows.select("text").mapInArrow(counted, "key binary, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key"), "bpe-shared")
    own = bloom_filter(shared, most=most_bits)
    bloom = spark.sparkContext.broadcast(own)

    def split(hits: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            encode, pieces = tokens.load(path)
            names, bits = [str(i) for i in range(len(pieces))], bloom.value
            for b in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
                texts = [x.as_py() for x in b.column("text")]
                raws = [t.encode() for t in texts]
                has = [tokens.SPECIAL not in t and any(bits.hit(key(r[s:e])) for s, e in chunks(r)) for t, r in zip(texts, raws)]
                keep = pa.array([h == hits for h in has])
                if hits:
                    found = [r for r, h in zip(raws, has) if h]
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").filter(keep), pa.array([hashlib.sha256(r).digest() for r in found], pa.binary()), b.column("text").filter(keep)], ["doc_id", "digest", "text"])
                else:
                    yield _batch([b.column("doc_id").filter(keep)], ["doc_id"], [_digests(encode(t), names, pieces) for t, h in zip(texts, has) if not h])

        return run

    direct = rows.mapInArrow(split(False), f"doc_id long, {RESULT}")
    texts_path = scratch(spark, "bpe-texts")
    rows.mapInArrow(split(True), "doc_id long, digest binary, text string").write.option("compression", "zstd").parquet(texts_path)
    joined = spark.read.schema("doc_id long, digest binary, text string").parquet(texts_path)

    def pieces_of(with_text: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits, seen = bloom.value, set()
            for b in batches:
                out: list[tuple] = []
                for x, d in zip(b.column("text"), b.column("digest")):
                    raw, digest = x.as_py().encode(), d.as_py()
                    if not with_text and digest in seen:
                        continue  # a copy within this task
                    seen.add(digest)
                    for i, (s, e) in enumerate(chunks(raw)):
                        k = key(raw[s:e])
                        if bits.hit(k):
                            if not with_text:
                                out.append((digest, i, k))
                            elif k not in seen:
                                seen.add(k)
                                out.append((k, raw[s:e]))
                columns = zip(*out) if out else [()] * (2 if with_text else 3)
                kinds = [pa.binary(), pa.binary()] if with_text else [pa.binary(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], ["key", "chunk"] if with_text else ["digest", "at", "key"])

        return run

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, _ = tokens.load(path)
        for b in batches:
            ids = [np.array(encode(c.as_py().decode()), np.uint32).tobytes() for c in b.column("chunk")]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(ids, pa.binary())], ["key", "ids"])

    def assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, pieces = tokens.load(path)
        names, lengths = [str(i) for i in range(len(pieces))], np.array([len(p) for p in pieces])
        for b in batches:
            out = []
            for x, parts in zip(b.column("text"), b.column("parts")):
                known = {p["at"]: np.frombuffer(p["ids"], np.uint32).tolist() for p in parts.as_py() or ()}
                out.append(_digests(assemble(x.as_py().encode(), known, encode, lengths), names, pieces))
            yield _batch([b.column("digest")], ["digest"], out)

    texts = joined.select("digest", "text")
    # each shared chunk is encoded once, whichever texts hold it
    pieces = texts.mapInArrow(pieces_of(True), "key binary, chunk binary").dropDuplicates(["key"])
    pieces = pieces.join(shared, "key", "left_semi") if own.bits is None else pieces
    ids = written(pieces.mapInArrow(encoded, "key binary, ids binary"), "bpe-chunks")
    refs = texts.mapInArrow(pieces_of(False), "digest binary, at int, key binary").distinct()
    parts = refs.join(ids, "key").groupBy("digest").agg(F.collect_list(F.struct("at", "ids")).alias("parts"))
    whole = texts.dropDuplicates(["digest"]).join(parts, "digest", "left").mapInArrow(assembled, f"digest binary, {RESULT}")
    done = joined.select("doc_id", "digest").join(written(whole, "bpe-results"), "digest")
    return direct.union(done.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256"))


def op7_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded texts of all documents by byte_bpe_50k.json."""
    import public_tokenizers

    from .common import table

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
