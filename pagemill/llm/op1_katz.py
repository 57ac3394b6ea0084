"""Language-model scores by a Katz back-off model.

Tokens are lower-cased (A-Z) words and an end; every training word is a word of
the model, and words never seen in training are one more, the unknown word. The
model's n-grams go up to ORDER words. Counts up to CUTOFF are discounted by
Good-Turing; after a context, unseen words get the remaining mass in proportion
to their probability after the context without its first word, by a back-off
weight that makes each context's probabilities sum to 1. A context whose counts
are all above the cutoff counts one event more, so that it also leaves some mass.
A word is scored after its longest context, and recursively after shorter ones
where it was never seen.

The tables of a level (n-grams of so many words) are partitioned by the last
word of the context: a row for each part, which holds the part's words, its
n-grams with their counts, and its contexts with their totals and back-off
weights, packed (the top level's weights in rows beside its n-grams). Level by
level, texts are worked off in blocks; a block's n-grams are sorted, packed and
sent to their parts once each. To find its weights, a part needs the
probabilities of its n-grams without their first word: these lie in the lower
level's part of the same number, or it asks for them. At the top level n-grams go
with the numbers of the texts that hold them, and sums for each text come back;
only n-grams that were never seen in training are looked up on the levels below.

Contexts with more than a fixed share of all tokens would make a part too large.
They are on a list, HOT_CONTEXTS a level at most, which goes to all tasks with
their totals and weights; their n-grams are dealt out by one word more. The
HOT_WORDS most frequent words go to all tasks with their counts, which spares
most questions and changes no result. All other tables stay distributed. Blocks
and parts hold BLOCK_TOKENS and PART_TOKENS tokens; with more memory for each
task, larger ones make messages fewer at the largest inputs.

A word is known by its place among the most frequent words or by 47 bits of a
hash, a context on the list of the hottest by 63 bits; an n-gram is the tuple of
its words.

Defined results: a null text is empty, one end token; a very long text is part
of one block, which grows by it; null ids belong to the training rows and keep
their rows; a repeated row counts again; without training rows every token is
unknown and has probability 1; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache, reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, table, tidy, whole_text, written

ORDER = 3
CUTOFF = 5
HOT_WORDS, HOT_CONTEXTS = 2**20, 2**20
ROUNDS = 3
BLOCK_TOKENS = 500_000
PART_TOKENS = 1_200_000
ADD = 0.1
START, END = 0, 1  # hashes that stand for the start of a text and the end token
RARE = 2**48  # a word's code: its place among the most frequent words, from 1 on, or its hash and this

# -- packed numbers ---------------------------------------------------------


@lru_cache(maxsize=1)
def _codecs():
    import zstandard

    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(**arrays: np.ndarray) -> bytes:
    """Named arrays of numbers: whole ones from 0 on in as many byte planes as the
    largest needs, ascending ones as differences; others as doubles."""
    head, body = [], []
    for name, x in arrays.items():
        if x.dtype.kind == "f":
            kind, width = "f", 8
            x = np.ascontiguousarray(x, np.float64)
        else:
            x = np.ascontiguousarray(x, np.int64)
            kind = "i"
            if len(x) > 1 and x[0] <= x[-1]:
                step = np.diff(x, prepend=0)
                if step.min() >= 0:
                    kind, x = "s", step
            width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
        head.append((name, kind, width, len(x)))
        if width <= 4:
            size = (1, 2, 4, 4)[width - 1]
            x = x.astype(f"u{size}")
        else:
            size = 8
        body.append(x.view(np.uint8).reshape(-1, size)[:, :width].T.tobytes())
    top = json.dumps(head).encode()
    return len(top).to_bytes(4, "little") + top + _codecs()[0].compress(b"".join(body))


def unpack(data: bytes, narrow: bool = False) -> dict[str, np.ndarray]:
    """The arrays; narrow: those but `words` in 32 bits where they fit."""
    size = int.from_bytes(data[:4], "little")
    raw = np.frombuffer(_codecs()[1].decompress(data[4 + size :]), np.uint8)
    out, at = {}, 0
    for name, kind, width, n in json.loads(data[4 : 4 + size]):
        planes = raw[at : at + n * width].reshape(width, n)
        at += n * width
        if width == 1:
            x = planes[0]
        else:
            x = np.zeros((n, 4 if width <= 4 else 8), np.uint8)
            x[:, :width] = planes.T
            x = x.view(np.float64 if kind == "f" else np.uint32 if width <= 4 else np.int64).ravel()
        small = narrow and kind != "f" and name != "words"
        if kind == "s":
            x = np.cumsum(x, dtype=np.int64)
            small = small and (not n or x[-1] < 2**31)
        elif kind == "i":
            small = small and (width <= 3 or width == 4 and (not n or int(x.max()) < 2**31))
        out[name] = x if kind == "f" else x.astype(np.int32 if small else np.int64)
    return out


def find(ascending: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Places of x in an ascending array, -1 where absent."""
    if not len(ascending):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(ascending, x), len(ascending) - 1)
    return np.where(ascending[at] == x, at, -1)


def scrambled(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, to 63 bits."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return ((x ^ (x >> np.uint64(33))) >> np.uint64(1)).astype(np.int64)


# -- texts to words ---------------------------------------------------------

#: A number for each byte; A-Z have those of a-z.
_BYTE = np.frombuffer(b"".join(sha256(bytes([b])).digest()[:8] for b in bytes(range(256)).lower()), np.uint64)
_BASE = 0x9E3779B97F4A7C15
_PIECE, _BATCH = 2**17, 2**22


@lru_cache(maxsize=2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 2**64)):
        x = np.full(1 << bits, base, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def is_space(x: np.ndarray) -> np.ndarray:
    """Which bytes are 0x20 or 0x09 to 0x0D."""
    return (x - np.uint8(9) < np.uint8(5)) | (x == np.uint8(0x20))


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, words of each text) of texts that lie one behind the other
    in data, which offsets cut. A hash is that of the word's bytes alone."""
    hashes, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    room = np.empty(0, np.uint64)
    lo, n = int(offsets[0]), int(offsets[-1])
    while lo < n:
        hi = min(n, lo + _PIECE)
        while hi < n and not is_space(data[hi : hi + 1])[0] and offsets[np.searchsorted(offsets, hi)] != hi:
            stop = min(n, hi + 4096, int(offsets[np.searchsorted(offsets, hi)]))
            gap = np.flatnonzero(is_space(data[hi:stop]))
            hi = hi + int(gap[0]) if len(gap) else stop
        x = data[lo:hi]
        # where a word may not go on: behind the piece, at a space, where a text begins
        stop = np.append(is_space(x), True)
        word = ~stop[:-1]
        cut = offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi)] - lo
        begins = np.append(True, stop[:-2])
        begins[cut] = True
        stop[cut] = True
        start, last = np.flatnonzero(word & begins), np.flatnonzero(word & stop[1:])
        power, inverse = _powers(max(18, (len(x) - 1).bit_length()))
        if len(room) < 2 * len(x):
            room = np.empty(2 * len(x), np.uint64)
        value, sums = room[: len(x)], room[len(x) : 2 * len(x)]
        np.take(_BYTE, x, out=value, mode="clip")
        np.multiply(value, power[: len(x)], out=value)
        np.cumsum(value, out=sums)
        hashes.append((scrambled((sums[last] - sums[start] + value[start]) * inverse[start]) >> 15) | 2)  # over START and END
        at.append(start + lo)
        lo = hi
    place = np.searchsorted(np.concatenate(at), offsets)
    return np.concatenate(hashes), np.diff(place)


@dataclass
class Block:
    """Texts and the hashes of their tokens, one text behind the other."""

    ids: pa.Array
    held_out: np.ndarray
    hashes: np.ndarray
    n: np.ndarray  # tokens of each text

    def training_first(self) -> Block:
        """The same texts, those held out behind the others."""
        order = np.argsort(self.held_out, kind="stable")
        n = self.n[order]
        start = (np.cumsum(self.n) - self.n)[order]
        at = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(len(self.hashes))
        return Block(self.ids.take(pa.array(order)), self.held_out[order], self.hashes[at], n)

    def numbered(self, model: Model, order: int, texts: np.ndarray | None = None) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """(ascending codes of words from START on, for each token the numbers of itself and
        of the order - 1 tokens before it, its text), of all texts or of some."""
        h, n = self.hashes, self.n
        if texts is not None:
            h, n = h[np.repeat(texts, n)], n[texts]
        words, own = np.unique(h, return_inverse=True)
        words = model.codes(words + RARE)
        if len(model.words):
            sort = np.argsort(words)
            place = np.empty(len(sort), np.int64)
            place[sort] = np.arange(len(sort))
            words, own = words[sort], place[own]
        first = np.cumsum(n) - n
        out = [own + 1]
        for _ in range(order - 1):
            before = np.zeros_like(out[-1])
            before[1:] = out[-1][:-1]
            before[first] = 0
            out.append(before)
        return np.append(START, words), out, np.repeat(np.arange(len(n)), n)


def blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[Block]:
    """Blocks of whole texts of `size` tokens or little more."""
    ids: list[pa.Array] = []
    held: list[np.ndarray] = []
    parts: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    have = 0

    def block() -> Block:
        return Block(pa.concat_arrays(ids), np.concatenate(held), np.concatenate(parts), np.concatenate(counts))

    for b in batches:
        if not b.num_rows:
            continue
        text = b.column("text").cast(pa.large_string())
        _, offsets, data = text.buffers()
        offsets = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1]
        data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
        flags = b.column("held_out").to_numpy(zero_copy_only=False)
        at = 0
        while at < len(text):  # some texts at a time
            till = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _BATCH, side="right")) - 1)
            h, n = words_of(data, offsets[at : till + 1])
            n = n + 1
            tokens = np.full(int(n.sum()), END, np.int64)
            ends = np.cumsum(n)
            inner = np.ones(len(tokens), bool)
            inner[ends - 1] = False
            tokens[inner] = h
            lo = 0
            while lo < len(n):
                base = int(ends[lo - 1]) if lo else 0
                hi = min(len(n), int(np.searchsorted(ends, base + size - have)) + 1)
                ids.append(b.column("doc_id").slice(at + lo, hi - lo))
                held.append(flags[at + lo : at + hi])
                parts.append(tokens[base : int(ends[hi - 1])])
                counts.append(n[lo:hi])
                have += len(parts[-1])
                lo = hi
                if have >= size:
                    yield block()
                    ids, held, parts, counts, have = [], [], [], [], 0
            at = till
    if ids:
        yield block()


# -- the model --------------------------------------------------------------


def discounts(n: list[int], cutoff: int = CUTOFF) -> np.ndarray:
    """Factor of each count 0..cutoff from n[r], the number of n-grams that occur
    r times (r up to cutoff + 1). Where the numbers are too few for Good-Turing,
    half an occurrence is taken off each."""
    out = np.ones(cutoff + 1)
    rest = (cutoff + 1) * n[cutoff + 1] / n[1] if n[1] else 1.0
    for r in range(1, cutoff + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - rest) / (1 - rest) if n[r] and rest < 1 else 0.0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


def discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    return counts * np.where(counts < len(d), d[np.minimum(counts, len(d) - 1)], 1.0)


def context_key(words: list[np.ndarray]) -> np.ndarray:
    """A number for each context, given as columns of word hashes."""
    key = words[0]
    for w in words[1:]:
        key = scrambled(key * 0x2545F4914F6CDD1D + w)
    return key


@dataclass
class Hot:
    """Contexts of a level that are on the list, ascending by key."""

    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    total: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # occurrences, one more where no small count leaves mass
    full: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))  # whether that one more is counted
    weight: np.ndarray = field(default_factory=lambda: np.ones(0))


@dataclass
class Model:
    word_parts: int  # of the words
    parts: int = 1  # of the n-grams of each level above
    tokens: int = 0
    types: int = 0
    frequent: Broadcast | None = None  # (hashes and RARE of the most frequent words, ascending; their counts)
    scale: float = 1.0  # of word probabilities
    unknown: float = 1.0  # probability of the unknown word
    discount: dict[int, np.ndarray] = field(default_factory=dict)
    hot: dict[int, Hot] = field(default_factory=dict)

    @property
    def words(self) -> np.ndarray:
        return self.frequent.value[0] if self.frequent else np.zeros(0, np.int64)

    @property
    def counts(self) -> np.ndarray:
        return self.frequent.value[1] if self.frequent else np.zeros(0, np.int64)

    def now(self) -> Model:
        """As it is now: what tasks get with their function, but for the words, which go once."""
        return replace(self, discount=dict(self.discount), hot=dict(self.hot))

    def codes(self, full: np.ndarray) -> np.ndarray:
        """Codes of words given by hash and RARE."""
        at = find(self.words, full)
        return np.where(at >= 0, at + 1, full)

    def of_words(self, counts: np.ndarray) -> np.ndarray:
        """Probabilities of words by their counts."""
        if not self.tokens:
            return np.full(len(counts), self.unknown)
        return np.where(counts > 0, discounted(counts, self.discount[1]) * self.scale / self.tokens, self.unknown)

    def route(self, level: int, words: list[np.ndarray]) -> np.ndarray:
        """Parts of n-grams, given as columns of word hashes."""
        if level == 1:
            return scrambled(words[0]) % self.word_parts
        # by the last word of the context; where that is on the list by one word more, and so on
        key = words[-2]
        for k in range(2, level + 1):
            hot = self.hot.get(k)
            if hot is None or not len(hot.keys):
                break
            listed = find(hot.keys, context_key(words[level - k : -1])) >= 0
            key = np.where(listed, context_key(words[level - k - 1 : -1] if k < level else words), key)
        return scrambled(key) % self.parts

    def parts_of(self, level: int) -> int:
        return self.word_parts if level == 1 else self.parts


# -- messages ---------------------------------------------------------------

_ROW = "level int, part int, src long, kind int, data binary"
_NAMES = ["level", "part", "src", "kind", "data"]
_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
#: Kinds of rows: n-grams to count, those of texts to score, a part's table, questions,
#: answers, what a block's texts are, sums for them, and what depends on contexts on the list.
COUNT, SCORE, TABLE, ASK, ANSWER, META, SUMS, HELD = range(8)


def rows_of(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(_TYPES)], _NAMES)


def by_part(part: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Places of each part, in their order."""
    order = np.argsort(part.astype(np.uint16) if parts <= 2**16 else part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order])) + 1
    for x in np.split(order, cuts) if len(order) else ():
        yield int(part[x[0]]), x


def local(words: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The words that columns of numbers use, and the columns as numbers among these."""
    if len(words) <= 64 * len(columns[0]):
        used = np.zeros(len(words), bool)
        for c in columns:
            used[c] = True
        some = np.flatnonzero(used)
        number = np.empty(len(words), np.int64)
        number[some] = np.arange(len(some))
        return words[some], [number[c] for c in columns]
    some = np.unique(np.concatenate(columns))
    return words[some], [np.searchsorted(some, c) for c in columns]


def tuple_key(columns: list[np.ndarray], size: int) -> np.ndarray:
    """One number for each row of columns of numbers below size, in the rows' order."""
    key = columns[0].astype(np.int64)
    bound = size
    for c in columns[1:]:
        if bound * size >= 2**62:  # ranks of what there is so far
            values, key = np.unique(key, return_inverse=True)
            bound = len(values)
        key = key * size + c
        bound *= size
    return key


def distinct(columns: list[np.ndarray], sizes: list[int]) -> tuple[list[np.ndarray], np.ndarray]:
    """(columns of the distinct rows in ascending order, how often each occurs)."""
    bits = [max(1, (s - 1).bit_length()) for s in sizes]
    if sum(bits) > 62:
        order, first = grouped(tuple_key(columns, max(sizes)))
        return [c[order[first]] for c in columns], np.diff(np.append(first, len(order)))
    key = columns[0]
    for c, b in zip(columns[1:], bits[1:]):
        key = key << b | c
    key = np.sort(key)
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    n, key, out = np.diff(np.append(first, len(key))), key[first], []
    for b in bits[:0:-1]:
        out.append(key & ((1 << b) - 1))
        key = key >> b
    return [key, *out[::-1]], n


def names(k: int) -> list[str]:
    return [f"c{i}" for i in range(k)]


def together(messages: list[dict[str, np.ndarray]], k: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(ascending words of all messages, columns of n-grams as numbers among them); the
    messages lose theirs."""
    sizes = [len(m["words"]) for m in messages]
    words, number = np.unique(np.concatenate([m.pop("words") for m in messages]), return_inverse=True)
    if len(words) < 2**31:
        number = number.astype(np.int32)
    base = np.cumsum(sizes) - sizes
    return words, [np.concatenate([number[b + m.pop(c)] for b, m in zip(base, messages)]) for c in names(k)]


def grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order that sorts key, where its groups begin)."""
    order = np.argsort(key)
    s = key[order]
    return order, np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.zeros(0, np.int64)


def times(counts: np.ndarray) -> np.ndarray:
    """How many counts are 1, ..., CUTOFF + 1."""
    return np.bincount(np.minimum(counts, CUTOFF + 2), minlength=CUTOFF + 3)[1 : CUTOFF + 2]


def block_number(i: int) -> int:
    from pyspark import TaskContext

    return (TaskContext.get().partitionId() << 32) + i


# -- counting ---------------------------------------------------------------


def counting(level: int, model: Model, block_tokens: int):
    """Sends the n-grams of the training texts, with their counts, to their parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, block_tokens):
            if b.held_out.all():
                continue
            if level == 1:
                words, n = np.unique(b.hashes[np.repeat(~b.held_out, b.n)], return_counts=True)
                words, columns = words + RARE, [np.arange(len(words))]
            else:
                words, tokens, _ = b.numbered(model, level, ~b.held_out)
                columns, n = distinct(tokens[::-1], [len(words)] * level)
            out = []
            for p, x in by_part(model.route(level, [words[c] for c in columns]), model.parts_of(level)):
                own, cols = local(words, [c[x] for c in columns])
                out.append((level, p, 0, COUNT, pack(words=own, n=n[x], **dict(zip(names(level), cols)))))
            yield rows_of(out)
            del b, words, columns, n, out
        tidy()

    return run


def counted(level: int):
    """The table of a part from what was sent to it."""

    def work(key, t):
        messages = [unpack(x.as_py()) for x in t.column("data")]
        words, columns = together(messages, level)
        order, first = grouped(tuple_key(columns, len(words)))
        n = np.add.reduceat(np.concatenate([m["n"] for m in messages])[order], first)
        columns = [c[order[first]] for c in columns]
        data = pack(words=words, n=n, **dict(zip(names(level), columns)), times=times(n))
        return pa.Table.from_batches([rows_of([(level, key[1].as_py(), 0, TABLE, data)])])

    def run(key, t):
        out = work(key, t)
        tidy()
        return out

    return run


def table_of(level: int, rows: DataFrame, model: Model, block_tokens: int, name: str) -> DataFrame:
    sent = rows.mapInArrow(counting(level, model.now(), block_tokens), _ROW)
    return written(sent.groupBy("level", "part").applyInArrow(counted(level), _ROW), name, "uncompressed")


def summed(tables: DataFrame, bins: int = 512) -> dict[str, np.ndarray]:
    """Over all parts: times, the sum of counts, the number of n-grams, and how many
    there are by eighths of the logarithm of the count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column("data"):
                row = unpack(x.as_py())
                got = [*row["times"], row["n"].sum(), len(row["n"]), *np.bincount(np.floor(8 * np.log2(row["n"])).astype(np.int64), minlength=bins)]
                yield pa.RecordBatch.from_arrays([pa.array([list(map(int, got))], pa.list_(pa.int64()))], ["x"])

    each = tables.where(f"kind = {TABLE}").select("data").mapInArrow(run, "x array<long>")
    width = CUTOFF + 3 + bins
    got = each.agg(*[F.sum(F.col("x")[i]).alias(f"x{i}") for i in range(width)]).first()
    x = np.array([v or 0 for v in got], np.int64)
    return {"times": np.append(0, x[: CUTOFF + 1]), "tokens": x[CUTOFF + 1], "types": x[CUTOFF + 2], "bins": x[CUTOFF + 3 :]}


def frequent(level: int, tables: DataFrame, above: float) -> tuple[np.ndarray, np.ndarray]:
    """(keys, counts) of the n-grams with larger counts, ascending by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column("data"):
                row = unpack(x.as_py())
                some = row["n"] > above
                key = context_key([row["words"][row[c][some]] for c in names(level)])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(row["n"][some])], ["key", "n"])

    got = tables.where(f"kind = {TABLE}").select("data").mapInArrow(run, "key long, n long").toArrow()
    key, n = got.column("key").to_numpy(), got.column("n").to_numpy()
    order = np.argsort(key)
    return key[order], n[order]


# -- questions and weights --------------------------------------------------


def questions(level: int, row: dict[str, np.ndarray], model: Model) -> tuple[list[np.ndarray], list[tuple[int, int, np.ndarray]], np.ndarray]:
    """What a part of a level asks: (columns of the n-grams of one word less, in order;
    (level, part, places among them or among words) for each question; which words are
    asked for). N-grams of texts that were never seen ask for their last word too."""
    k = level
    suffix = [np.concatenate([row[c], row[f"o{c}"]]) if "oc0" in row else row[c] for c in names(k)][1:]
    _, first = np.unique(tuple_key(suffix, len(row["words"])), return_index=True)
    asked = [c[first] for c in suffix]
    last = np.unique(row[f"oc{k - 1}"]) if k > 2 and "oc0" in row else np.zeros(0, np.int64)
    out = []
    for lower, columns in ((k - 1, asked), (1, [last])):
        words = [row["words"][c] for c in columns]
        if lower == 1:  # the counts of the most frequent words are everywhere
            some = np.flatnonzero(words[0] >= RARE)
        else:  # what is not on the list lies in the part of the same number
            some = np.flatnonzero(find(model.hot[lower].keys, context_key(words[:-1])) >= 0)
        if len(some):
            out += [(lower, p, some[x]) for p, x in by_part(model.route(lower, [w[some] for w in words]), model.parts_of(lower))]
        if k == 2:
            break
    return asked, out, last


def looked_up(level: int, row: dict[str, np.ndarray] | None, words: np.ndarray, columns: list[np.ndarray], hot: Hot) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(count, total of the context, its weight) of n-grams, given as columns of numbers
    among words, by a part's table; 0, 0 and 1 where they were never seen."""
    n, total, weight = np.zeros(len(columns[0]), np.int64), np.zeros(len(columns[0]), np.int64), np.ones(len(columns[0]))
    if row is not None and len(row["n"]):
        size = len(row["words"]) + 1
        at = find(row["words"], words)
        columns_here = [at[c] for c in columns]

        def put(k: int, have: np.ndarray, *pairs: tuple[np.ndarray, np.ndarray]) -> None:
            there = np.logical_and.reduce([c >= 0 for c in columns_here[:k]])
            place = find(have, tuple_key([np.maximum(c, 0) for c in columns_here[:k]], size))
            seen = there & (place >= 0)
            for out, of in pairs:
                out[seen] = of[place[seen]]

        put(level, tuple_key([row[c] for c in names(level)], size), (n, row["n"]))
        if level > 1:
            put(level - 1, tuple_key([row[c][row["x"]] for c in names(level - 1)], size), (total, row["total"]), (weight, row["weight"]))
    if level > 1 and len(hot.keys):
        place = find(hot.keys, context_key([words[c] for c in columns[:-1]]))
        total[place >= 0], weight[place >= 0] = hot.total[place[place >= 0]], hot.weight[place[place >= 0]]
    return n, total, weight


def asking(level: int, model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, x in zip(b.column("part"), b.column("data")):
                row = unpack(x.as_py(), narrow=True)
                asked, each, last = questions(level, row, model)
                out = []
                for lower, q, at in each:
                    columns = [c[at] for c in asked] if lower == level - 1 else [last[at]]
                    words, columns = local(row["words"], columns)
                    out.append((lower, q, p.as_py(), ASK, pack(words=words, **dict(zip(names(lower), columns)))))
                yield rows_of(out)

    return run


def answering(model):
    """Answers in the order of the question: counts, totals, and the weight of the context
    where the n-gram was never seen."""

    def work(key, own, asked):
        m, level = model, key[0].as_py()
        row = unpack(own.column("data")[0].as_py(), narrow=True) if own.num_rows else None
        out = []
        for src, data in zip(asked.column("src"), asked.column("data")):
            q = unpack(data.as_py(), narrow=True)
            n, total, weight = looked_up(level, row, q["words"], [q[c] for c in names(level)], m.hot.get(level, Hot()))
            got = {"n": n} | ({"total": total, "weight": np.where(n > 0, 0.0, weight)} if level > 1 else {})
            out.append((0, src.as_py(), level << 32 | key[1].as_py(), ANSWER, pack(**got)))
        return pa.Table.from_batches([rows_of(out)])

    def run(key, own, asked):
        out = work(key, own, asked)
        tidy()
        return out

    return run


def weighted(level: int, model):
    """A part's table with its contexts' totals and weights; partial sums of contexts on
    the list; and sums for texts of n-grams that were never seen."""

    def work(key, own, answers):
        m = model
        if not own.num_rows:
            return pa.Table.from_batches([rows_of([])])
        p, row = own.column("part")[0].as_py(), unpack(own.column("data")[0].as_py(), narrow=True)
        row["n"] = row["n"].astype(np.int64)
        asked, each, last = questions(level, row, m)
        got, lower_row = {}, None
        for kind, s, d in zip(answers.column("kind"), answers.column("src"), answers.column("data")):
            if kind.as_py() == ANSWER:
                got[s.as_py()] = unpack(d.as_py())
            else:
                lower_row = unpack(d.as_py(), narrow=True)
        if level == 2:
            n, total, weight = np.zeros(len(asked[0]), np.int64), np.ones(len(asked[0]), np.int64), np.ones(len(asked[0]))
        else:
            n, total, weight = looked_up(level - 1, lower_row, row["words"], asked, Hot())
        del lower_row
        of_last = np.zeros(len(last), np.int64)
        for counts, place in ((n, asked[0]), (of_last, last)) if level == 2 else ((of_last, last),):
            code = row["words"][place]
            hot_word = code < RARE
            counts[hot_word] = m.counts[code[hot_word] - 1]
        for lower, q, at in each:
            a = got[lower << 32 | q]
            if lower > 1:
                n[at], total[at], weight[at] = a["n"], a["total"], a["weight"]
            else:
                (n if level == 2 else of_last)[at] = a["n"]
        size = len(row["words"])
        have = tuple_key(asked, size)

        def below(columns: list[np.ndarray], trained: bool) -> np.ndarray:
            """Probabilities of the last words after the contexts without their first words."""
            at = np.searchsorted(have, tuple_key(columns[1:], size))
            if level == 2:
                return m.of_words(n[at])
            seen = discounted(n[at], m.discount[level - 1]) / np.maximum(1, total[at])
            count = np.zeros(len(at), np.int64)
            unseen = n[at] == 0
            if trained and unseen.any():
                raise RuntimeError(f"part {p}: an n-gram was counted, but not the one without its first word")
            count[unseen] = of_last[np.searchsorted(last, columns[-1][unseen])]
            return np.where(unseen, weight[at] * m.of_words(count), seen)

        columns = [row[c] for c in names(level)]
        context = tuple_key(columns[:-1], size)
        x = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(context) else np.zeros(0, np.int64)
        small = np.maximum.reduceat(row["n"] <= CUTOFF, x) if len(x) else np.zeros(0, bool)
        sums = [np.add.reduceat(v, x) if len(x) else np.zeros(0) for v in (row["n"], discounted(row["n"], m.discount[level]), below(columns, True))]
        whole = sums[0] + ~small
        own_weight = (1 - sums[1] / whole) / (1 - sums[2]) if len(x) else np.zeros(0)
        keys = context_key([row["words"][c[x]] for c in columns[:-1]])
        listed = find(m.hot[level].keys, keys) >= 0
        out = []
        if listed.any():
            out.append((level, p, 0, HELD, pack(key=keys[listed], small=small[listed].astype(np.int64), mass=sums[1][listed].astype(float), below=sums[2][listed])))
        # the top level's n-grams stay where they are, and its weights beside them
        grams = {} if level == ORDER else {"words": row["words"], "n": row["n"]} | dict(zip(names(level), columns))
        out.append((level, p, 0, TABLE, pack(**grams, x=x[~listed], total=whole[~listed], weight=own_weight[~listed])))
        if "oc0" in row and len(row["oc0"]):
            columns = [row[f"o{c}"] for c in names(level)]
            score = np.log10(below(columns, False))
            open_keys = context_key([row["words"][c] for c in columns[:-1]])
            hot = find(m.hot[level].keys, open_keys) >= 0
            at = find(context[x], tuple_key(columns[:-1], size))
            cold = (at >= 0) & ~hot
            score[cold] += np.log10(own_weight[at[cold]])
            for b, where in by_block(row["block"]):
                doc, value = summed_by(row["doc"][where], row["on"][where] * score[where])
                out.append((0, 0, b, SUMS, pack(doc=doc, score=value)))
                h = where[hot[where]]
                if len(h):
                    out.append((0, 0, b, HELD, pack(doc=row["doc"][h], key=open_keys[h], n=row["on"][h], seen=np.zeros(len(h), np.int64))))
        return pa.Table.from_batches([rows_of(out)])

    def run(key, own, answers):
        out = work(key, own, answers)
        tidy()
        return out

    return run


def by_block(block: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order, first = grouped(block)
    for x in np.split(order, first[1:]) if len(order) else ():
        yield int(block[x[0]]), x


def summed_by(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    docs, at = np.unique(doc, return_inverse=True)
    return docs, np.bincount(at, value, minlength=len(docs)).astype(float)


def with_weights(level: int, tables: DataFrame, lower: DataFrame, model: Model, rounds: int = 1) -> DataFrame:
    """The rows of `weighted`, written; lower: the finished tables of the levels below.
    In rounds over the parts: what goes between parts is cleared after each."""
    own, lower = tables.where(f"kind = {TABLE}"), lower.where(f"kind = {TABLE}")
    asks = own.select("part", "data").mapInArrow(asking(level, model), _ROW)
    answers = lower.groupBy("level", "part").cogroup(asks.groupBy("level", "part")).applyInArrow(answering(model), _ROW)
    answers = written(answers, f"katz-answers-{level}", "uncompressed")
    beside = answers.unionByName(lower.where(f"level = {level - 1}")) if level > 2 else answers
    out = []
    for i in range(min(rounds, model.parts)):
        here = F.col("part") % min(rounds, model.parts) == i
        x = own.where(here).groupBy("part").cogroup(beside.where(here).groupBy("part")).applyInArrow(weighted(level, model), _ROW)
        out.append(written(x, f"katz-weights-{level}", "uncompressed"))
    discard(answers)
    return reduce(DataFrame.unionByName, out)


def listed(level: int, tables: DataFrame, model: Model) -> Hot:
    """The contexts on the list with their totals and weights, from the partial sums of the parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column("data"):
                r = unpack(x.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(r[c]) for c in ("key", "small", "mass", "below")], ["key", "small", "mass", "below"])

    each = tables.where(f"kind = {HELD} and level = {level}").select("data").mapInArrow(run, "key long, small long, mass double, below double")
    got = each.groupBy("key").agg(F.max("small").alias("small"), F.sum("mass").alias("mass"), F.sum("below").alias("below")).orderBy("key").toArrow()
    old = model.hot[level]
    at = find(got.column("key").to_numpy(), old.keys)
    small, mass, below = (got.column(c).to_numpy()[at] if got.num_rows else np.zeros(len(at)) for c in ("small", "mass", "below"))
    full = (small == 0) & (at >= 0)
    total = old.total + full
    return Hot(old.keys, total, full, np.where(at >= 0, (1 - mass / np.maximum(1, total)) / (1 - below), 1.0))


# -- scoring ----------------------------------------------------------------


def sending(model, block_tokens: int):
    """Sends the n-grams of all texts, with the texts that hold them, to their parts; so the
    words that are not among the most frequent; and what the texts are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model
        for i, b in enumerate(blocks(batches, block_tokens)):
            b = b.training_first()
            train = np.array([int((~b.held_out).sum())])
            number, docs = block_number(i), len(b.ids)
            words, tokens, doc = b.numbered(m, ORDER)
            is_hot = (words < RARE) & (words > START)
            hot = is_hot[tokens[0]]
            count = np.zeros(len(words), np.int64)
            count[is_hot] = m.counts[words[is_hot] - 1]
            value = np.log10(count + ADD)
            base = np.bincount(doc[hot], value[tokens[0][hot]], minlength=docs).astype(float)
            known = np.bincount(doc[hot], (count > 0)[tokens[0][hot]], minlength=docs).astype(np.int64)
            ids = b.ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            lacks = b.ids.is_null().to_numpy(zero_copy_only=False)
            out = [(0, number % m.parts, number, META, pack(sign=(ids < 0).astype(np.int64), ids=np.where(ids < 0, -(ids + 1), ids), null=lacks.astype(np.int64), held=b.held_out.astype(np.int64), n=b.n, base=base, known=known))]

            def message(level: int, at: np.ndarray | None) -> None:
                """The n-grams that end at these tokens, or at all."""
                columns = [c if at is None else c[at] for c in (*tokens[:level][::-1], doc)]  # noqa: B023
                (*columns, d), n = distinct(columns, [len(words)] * level + [docs])  # noqa: B023
                for p, x in by_part(m.route(level, [words[c] for c in columns]), m.parts_of(level)):  # noqa: B023
                    own, cols = local(words, [c[x] for c in columns])  # noqa: B023
                    out.append((level, p, number, SCORE, pack(words=own, doc=d[x], n=n[x], train=train, **dict(zip(names(level), cols)))))  # noqa: B023

            rare = np.flatnonzero(~hot)
            if len(rare):
                message(1, rare)
            message(ORDER, None)
            yield rows_of(out)
            del b, words, tokens, doc, out, message
        tidy()

    return run


def scored(model):
    """A part of the top level: its table, n-grams never seen, and sums for texts; a part of
    words: sums for texts; what blocks are goes on as it is."""

    def work(key, t):
        m, level, part = model, key[0].as_py(), key[1].as_py()
        if level == 0:
            return t
        out: list[tuple] = []
        sent = [(s.as_py(), unpack(d.as_py(), narrow=True)) for s, kind, d in zip(t.column("src"), t.column("kind"), t.column("data")) if kind.as_py() == SCORE]
        if level == 1:
            tables = [unpack(d.as_py()) for kind, d in zip(t.column("kind"), t.column("data")) if kind.as_py() == TABLE]
            for number, s in sent:
                n = np.zeros(len(s["words"]), np.int64)
                for x in tables:
                    at = find(x["words"], s["words"])
                    n[at >= 0] = x["n"][at[at >= 0]]  # a table of words has each once, in order
                n = n[s["c0"]]
                doc, base = summed_by(s["doc"], s["n"] * np.log10(n + ADD))
                out.append((0, 0, number, SUMS, pack(doc=doc, base=base, known=summed_by(s["doc"], s["n"] * (n > 0))[1].astype(np.int64))))
            return pa.Table.from_batches([rows_of(out)])
        words, columns = together([s for _, s in sent], level)
        size = len(words)
        order, first = grouped(tuple_key(columns, size))
        group = np.empty(len(order), np.int32 if len(order) < 2**31 else np.int64)
        group[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
        del order
        n = np.concatenate([s["n"] for _, s in sent])
        training = np.concatenate([s["doc"] < s["train"][0] for _, s in sent])
        count = np.bincount(group, n * training, minlength=len(first)).astype(np.int64)
        one = np.empty(len(first), np.int64)
        one[group] = np.arange(len(group))  # an n-gram's place among all
        each = [c[one] for c in columns]
        del columns, one
        context = tuple_key(each[:-1], size)
        x = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
        of = np.repeat(np.arange(len(x)), np.diff(np.append(x, len(context))))
        total = np.add.reduceat(count, x)
        small = np.maximum.reduceat((count > 0) & (count <= CUTOFF), x)
        keys = context_key([words[c[x]] for c in each[:-1]])
        hot = find(m.hot[level].keys, keys)
        # where no small count leaves mass, one event more; of contexts on the list that is known later
        total = np.where(hot >= 0, m.hot[level].total[hot] if len(m.hot[level].keys) else 0, total + (~small & (total > 0)))
        value = np.log10(np.maximum(1, count) / np.maximum(1, total)[of])
        maybe = ((hot >= 0) & ~small)[of]
        base = 0
        for number, s in sent:
            g = group[base : base + len(s["doc"])]
            base += len(g)
            c = count[g]
            seen = c > 0
            doc, at = np.unique(s["doc"][seen], return_inverse=True)
            times_in = s["n"][seen]
            # and how many tokens have each count that is discounted
            small_counts = np.bincount(at * (CUTOFF + 1) + np.minimum(c[seen], CUTOFF + 1) - 1, times_in, minlength=len(doc) * (CUTOFF + 1)).reshape(-1, CUTOFF + 1)[:, :CUTOFF]
            score = np.bincount(at, times_in * value[g[seen]], minlength=len(doc)).astype(float)
            out.append((0, 0, number, SUMS, pack(doc=doc, score=score, small=small_counts.astype(np.int64).ravel())))
            later = seen & maybe[g]
            if later.any():
                out.append((0, 0, number, HELD, pack(doc=s["doc"][later], key=keys[of[g[later]]], n=s["n"][later], seen=np.ones(int(later.sum()), np.int64))))
        some = count > 0
        opens = np.flatnonzero(~some[group])
        block = np.repeat([number for number, _ in sent], [len(s["doc"]) for _, s in sent])
        doc = np.concatenate([s["doc"] for _, s in sent])
        data = pack(
            words=words, n=count[some], **{c: e[some] for c, e in zip(names(level), each)}, times=times(count[some]),
            **{f"o{c}": e[group[opens]] for c, e in zip(names(level), each)}, block=block[opens], doc=doc[opens], on=n[opens],
        )
        out.append((level, part, 0, TABLE, data))
        return pa.Table.from_batches([rows_of(out)])

    def run(key, t):
        out = work(key, t)
        tidy()
        return out

    return run


def gathering(model):
    def work(key, t):
        m = model
        rows = [(kind.as_py(), unpack(d.as_py())) for kind, d in zip(t.column("kind"), t.column("data"))]
        meta = next(r for kind, r in rows if kind == META)
        score, base, known = np.zeros(len(meta["n"])), meta["base"], meta["known"].copy()
        d, hot = np.log10(m.discount[ORDER]), m.hot[ORDER]
        for kind, r in rows:
            if kind == SUMS:
                if "score" in r:
                    score[r["doc"]] += r["score"]
                if "small" in r:
                    score[r["doc"]] += r["small"].reshape(-1, CUTOFF) @ d[1:]
                if "base" in r:
                    base[r["doc"]] += r["base"]
                    known[r["doc"]] += r["known"]
            elif kind == HELD:
                at = find(hot.keys, r["key"])
                total = hot.total[at]
                more = np.where(r["seen"] > 0, np.where(hot.full[at], np.log10((total - 1) / total), 0.0), np.log10(hot.weight[at]))
                np.add.at(score, r["doc"], r["n"] * more)
        ids = np.where(meta["sign"] > 0, -meta["ids"] - 1, meta["ids"])
        return pa.table({
            "doc_id": pa.array(ids, pa.int64(), mask=meta["null"] > 0), "held_out": pa.array(meta["held"] > 0), "n_tokens": meta["n"], "n_known": known,
            "train_tokens": np.full(len(ids), m.tokens, np.int64), "base_score": base - meta["n"] * np.log10(m.tokens + ADD * (m.types + 1)), "score": score,
        })

    def run(key, t):
        out = work(key, t)
        tidy()
        return out

    return run


# -- all together -----------------------------------------------------------


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))


def hot_contexts(level: int, tables: DataFrame | None, model: Model, most: float, texts: int) -> Hot:
    """The contexts of a level with more than `most` occurrences: n-grams of the level
    below, and the start of a text."""
    keys, total = frequent(level - 1, tables, most) if tables is not None else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    if level == 2:  # a table of words has hashes
        keys = model.codes(keys)
        order = np.argsort(keys)
        keys, total = keys[order], total[order]
    if texts > most:
        start = context_key([np.full(1, START, np.int64)] * (level - 1))
        keys, total = np.append(keys, start), np.append(total, texts)
        order = np.argsort(keys)
        keys, total = keys[order], total[order]
    return Hot(keys, total, np.zeros(len(keys), bool), np.ones(len(keys)))


def score(docs: DataFrame, hot_words: int = HOT_WORDS, part_tokens: int = PART_TOKENS, block_tokens: int = BLOCK_TOKENS, hot_share: float = 1 / 8) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row.
    Contexts of more than hot_share of a part's tokens are on the list."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", held_out().alias("held_out"), whole_text().alias("text"))
    m = Model(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))  # words are few beside n-grams
    words = table_of(1, rows, m, block_tokens, "katz-words")
    got = summed(words)
    m.tokens, m.types = int(got["tokens"]), int(got["types"])
    m.parts = max(1, -(-m.tokens // part_tokens))
    m.discount[1] = discounts(got["times"].tolist())
    # the most frequent words: whole bins of counts from the top
    top = np.cumsum(got["bins"][::-1])[::-1]
    m.frequent = spark.sparkContext.broadcast(frequent(1, words, 2 ** (int(np.flatnonzero(top <= hot_words)[0]) / 8) * (1 - 1e-9) if (top <= hot_words).any() else np.inf))
    # what small counts leave to the unknown word; without any, one event more
    small = got["times"][1 : CUTOFF + 1]
    left = float((small * np.arange(1, CUTOFF + 1) * (1 - m.discount[1][1:])).sum())
    if m.tokens:
        m.scale = 1.0 if left > 0 else m.tokens / (m.tokens + 1)
        m.unknown = left / m.tokens if left > 0 else 1 / (m.tokens + 1)
    texts = rows.where(~F.col("held_out")).count()
    most = max(part_tokens * hot_share, m.tokens / HOT_CONTEXTS)
    below, finished = words, words
    for level in range(2, ORDER):
        m.hot[level] = hot_contexts(level, below, m, most, texts)
        counts = table_of(level, rows, m, block_tokens, f"katz-counts-{level}")
        m.discount[level] = discounts(summed(counts)["times"].tolist())
        tables = with_weights(level, counts, finished, m.now())
        discard(counts)
        m.hot[level] = listed(level, tables, m)
        below, finished = tables, finished.unionByName(tables)
    m.hot[ORDER] = hot_contexts(ORDER, below, m, most, texts)
    shared = m.now()
    sent = rows.mapInArrow(sending(shared, block_tokens), _ROW).unionByName(words)
    top = written(sent.groupBy("level", "part").applyInArrow(scored(shared), _ROW), "katz-top", "uncompressed")
    m.discount[ORDER] = discounts(summed(top)["times"].tolist())
    last = with_weights(ORDER, top, finished, m.now(), ROUNDS)
    m.hot[ORDER] = listed(ORDER, last, m)
    sums = top.where(f"kind in ({META}, {SUMS}, {HELD})").unionByName(last.where(f"kind = {SUMS} or kind = {HELD} and level = 0"))
    return sums.groupBy("src").applyInArrow(gathering(m.now()), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op1_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by the model of those that are not held out."""
    return score(table(spark, sf_dir, "documents"))
