"""Byte-level BPE by way of a sentencepiece model that is serialised from the vocabulary.

Each rank becomes a piece: its bytes mapped to printable characters, scored by the negative
rank, under an identity normaliser. Sentencepiece then merges the pair of the highest
score, which is the lowest rank, leftmost first, as rank BPE does. Every pre-token is encoded by
itself; a pre-token that is a piece is that piece, as rank encoders define it. Decoding maps
ids to pieces and characters back to bytes.

Defined cases: null counts as empty; an empty text has no ids; texts of any length are
encoded whole, and each distinct pre-token once for a worker's current cache; repeated rows are
encoded alike; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .bpe import PATTERN, byte_chars, read_ranks
from .common import chunks, map_arrow, out_batch, table

#: Pre-tokens, and their characters, that a worker remembers before it starts afresh; memory only, results do not depend on it.
REMEMBERED, REMEMBERED_CHARS = 300_000, 8_000_000


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | str | int | float) -> bytes:
    """One protobuf field: int as varint, float as 32 bits, text and bytes with their length."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    value = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model whose id for each piece is its rank; the unknown piece comes last.

    Field numbers are those of sentencepiece_model.proto: pieces 1 (piece 1, score 2, type 3),
    trainer 2 (model type 3, size 4, ids of unk, bos, eos, pad 40 to 43), normaliser 3 (name 1,
    prefix 3, extra white space 4, escaping 5).
    """
    chars = byte_chars()
    by_rank = sorted(ranks, key=ranks.__getitem__)
    if [ranks[p] for p in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks are not 0 to n - 1")
    pieces = [_field(1, _field(1, "".join(chars[b] for b in p)) + _field(2, -float(r)) + _field(3, 1)) for r, p in enumerate(by_rank)]
    pieces.append(_field(1, _field(1, "<unk>") + _field(2, 0.0) + _field(3, 2)))
    none = (1 << 64) - 1  # -1
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(by_rank)) + _field(41, none) + _field(42, none) + _field(43, none)
    normaliser = _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encodes and decodes pre-tokens; remembers those it has seen."""

    def __init__(self, vocabulary: bytes):
        import regex
        import sentencepiece

        self.ranks = read_ranks(vocabulary)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.ranks))
        self.chars = byte_chars()
        back = {c: b for b, c in enumerate(self.chars)}
        self.pieces = [bytes(back[c] for c in self.model.id_to_piece(i)) for i in range(len(self.ranks))]
        self.split = regex.compile(PATTERN).findall
        self.mapped = str.maketrans({b: c for b, c in enumerate(self.chars)})
        self.seen: dict[str, tuple[str, int, bytes]] = {}
        self.seen_chars = 0

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))

    def _learn(self, words: list[str]) -> None:
        raw = [w.encode() for w in words]
        self.seen_chars += sum(map(len, words))
        coded = self.model.encode([r.decode("latin-1").translate(self.mapped) for r in raw], num_threads=1)
        for w, r, ids in zip(words, raw, coded):
            if (whole := self.ranks.get(r)) is not None:
                ids = [whole]
            self.seen[w] = (",".join(map(str, ids)), len(ids), self.decode(ids))

    def digest(self, texts: list[str]) -> tuple[list[int], list[str], list[str]]:
        """Number of ids, digest of the ids and digest of the decoded bytes of each text."""
        split = [self.split(t) for t in texts]
        if len(self.seen) > REMEMBERED or self.seen_chars > REMEMBERED_CHARS:
            self.seen.clear()
            self.seen_chars = 0
        if new := list(set().union(*split) - self.seen.keys()):
            self._learn(new)
        counts, ids, decoded = [], [], []
        for words in split:
            found = list(map(self.seen.__getitem__, words))
            counts.append(sum(f[1] for f in found))
            ids.append(hashlib.sha256(",".join([f[0] for f in found]).encode()).hexdigest())
            decoded.append(hashlib.sha256(b"".join([f[2] for f in found])).hexdigest())
        return counts, ids, decoded

    def encode(self, text: str) -> list[int]:
        words = self.split(text)
        if new := list(set(words) - self.seen.keys()):
            self._learn(new)
        return [int(i) for w in words for i in self.seen[w][0].split(",")]


@lru_cache(maxsize=1)
def codec(vocabulary: bytes) -> Codec:
    return Codec(vocabulary)


def round_trip(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    vocabulary = Path(vocabulary_path).read_bytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for batch in batches:
            for part, texts in chunks(batch):
                counts, ids, decoded = own.digest(texts)
                yield out_batch({"doc_id": part.column("doc_id"), "n_tokens": counts, "ids_sha256": ids, "decoded_sha256": decoded}, {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()})

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op10_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text by byte_bpe_multi_50k.tiktoken, encoded and decoded."""
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
