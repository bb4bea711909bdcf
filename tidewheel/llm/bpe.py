"""Byte-level BPE vocabularies read from the public files, as bytes that travel in a task's closure."""

from __future__ import annotations

import base64
import json
from functools import lru_cache

#: The split pattern of byte-level BPE, and the string of its one special token.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_chars() -> list[str]:
    """The printable character that stands for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in chars:
            chars[b] = chr(extra)
            extra += 1
    return [chars[b] for b in range(256)]


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a .tiktoken file: a base64 piece and its rank on each line."""
    return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, data.splitlines()) if piece}


def ranks_of_json(data: bytes) -> tuple[dict[bytes, int], dict[str, int]]:
    """Ranks and special tokens of a byte-level BPE tokenizer.json.

    Merging by rank equals applying the merge list only if ids follow the order of
    the merges, which is checked; ValueError otherwise.
    """
    model = json.loads(data)
    pre = model["pre_tokenizer"] or {}
    if model["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in model["added_tokens"]):
        raise ValueError("not a plain byte-level BPE tokenizer")
    vocab, back = model["model"]["vocab"], {c: b for b, c in enumerate(byte_chars())}
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
    order = [vocab[a + b] for a, b in merges]
    special = {t["content"]: t["id"] for t in model["added_tokens"]}
    if order != sorted(set(order)):
        raise ValueError("ids do not follow the order of the merges")
    return {bytes(back[c] for c in piece): i for piece, i in vocab.items() if piece not in special}, special


@lru_cache(maxsize=2)
def fast_encoding(data: bytes):
    """A rank encoder with the ids that the tokenizers library gives for this tokenizer.json.

    tests/llm compares it with that library on every code point and on random texts;
    it is about five times as fast. Special strings inside a text become their ids, the
    library's default.
    """
    import tiktoken

    ranks, special = ranks_of_json(data)
    return tiktoken.Encoding("json", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


def encoder(data: bytes):
    """The function from a text to its ids, a uint32 array without added special tokens; get it once for many texts."""
    encode = fast_encoding(data).encode_to_numpy
    return lambda text: encode(text, allowed_special="all")


def encode_ids(data: bytes, text: str):
    """Token ids of one text."""
    return encoder(data)(text)
