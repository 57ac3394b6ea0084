"""The public byte-level BPE vocabulary, as the tokenizers library applies it.

The ranks are run by tiktoken, whose merge loop is several times faster; that
both libraries give the same ids for every code point, and for the special
string, is tested (tests/llm/test_tokens_and_cache.py). A text on which tiktoken fails
falls back to the tokenizers library.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

from .common import tidy

SPECIAL = "<|endoftext|>"


@lru_cache(maxsize=4)
def library(path: str):
    """The tokenizers library's own tokenizer, for texts on which tiktoken fails."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


@lru_cache(maxsize=4)
def load(path: str):
    """(encode(text) -> ids, byte strings by id) for a tokenizers .json of byte-level BPE."""
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec["pre_tokenizer"], spec["model"]
    if spec["normalizer"] or model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"]:
        raise ValueError(f"{path} is not plain byte-level BPE")
    # the printable alphabet of byte-level BPE: printable bytes stand for themselves, the others for U+0100 and on
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    alphabet = {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(x for x in range(256) if x not in set(plain))}
    to_byte = {c: b for b, c in alphabet.items()}
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    vocab = {bytes(to_byte[c] for c in piece): i for piece, i in model["vocab"].items() if piece not in special}
    pieces = {i: piece for piece, i in vocab.items()} | {i: s.encode() for s, i in special.items()}
    # tiktoken merges by rank: the order of ids must be that of the merges
    ranks = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if ranks != sorted(ranks):
        raise ValueError(f"{path}: its ids do not follow its merges")
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=vocab, special_tokens=special)
    names = [pieces.get(i, b"") for i in range(max(pieces) + 1)]
    del spec, model, vocab, pieces, ranks
    tidy()

    def encode(text: str) -> list[int]:
        try:
            return fast.encode(text, allowed_special="all")
        except BaseException as e:  # a Rust panic is no Exception, and its type can't be imported
            if type(e).__name__ != "PanicException" and not isinstance(e, ValueError):
                raise
            return library(path).encode(text, add_special_tokens=False).ids

    return encode, names


def version(path: str) -> str:
    """Digest of what decides the counts: the tokenizer's file and its options."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + b"\0add_special_tokens=False").hexdigest()
