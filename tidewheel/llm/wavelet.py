"""Token ids in one compressed file for each shard: a wavelet matrix.

Ids of a shard are numbered by falling frequency; each bit of the number is a plane, and each
plane orders its ids by the bits before, zeros first. Ranks over the planes give access
to any token, the count of an id in a range, and the place of its k-th occurrence, from the file
alone. A plane is compressed in blocks, and the file has, for each block, where it lies and how many ones come before it. So opening a file
inflates nothing, and one access inflates one block of each plane; a plane of rare bits takes next to nothing.

Documents are sorted by doc_id over range partitions (ties by content, then by place, so that neither a hot doc_id nor a repeated row
fills one task), tokenised there, and cut into shards of bounded length. A shard is a row of a
Parquet table whose ``payload`` is the file, because executors of a cluster share only stores that
Spark writes. The place of a document is the tokens of the
partitions before, of its partition's shards before, and its offset in the shard.

Defined cases: null and empty texts are the end id alone; repeated rows are stored each; a text of any
length stays whole in its shard; an empty table gives no shards and an empty result; a null doc_id
sorts first and is stored as such; extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import cached_property
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .bpe import encoder, ranks_of_json
from .common import chunks, fits, map_arrow, out_batch, scratch, table

MAGIC = b"TWWM\x02"
#: Bytes of a block of a plane; the rank directory has an entry for each.
BLOCK = 1 << 14
#: A shard is closed when it holds this many tokens.
SHARD_TOKENS = 1 << 21
#: Inflated blocks that a reader keeps.
OPEN_BLOCKS = 64
SHARD = "part int, seq int, n_docs bigint, n_tokens bigint, payload binary"
#: The head: tokens, documents, distinct tokens, planes, blocks of a plane.
HEAD = struct.Struct("<QQIII")


def build(ids: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray) -> bytes:
    """The file of one shard: ids of its documents one after another.

    After the head come the ones before each block of each plane, and the ends of all parts; then the parts: alphabet,
    doc_ids, which of them are null, lengths, and the blocks, plane by plane.
    """
    import zstandard

    counts = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    alphabet = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)].astype(np.uint32)
    number = np.zeros(len(counts), np.uint16 if len(alphabet) <= 1 << 16 else np.uint32)
    number[alphabet] = np.arange(len(alphabet))
    now, bits = number[ids], max(1, (len(alphabet) - 1).bit_length())
    null = np.array([d is None for d in doc_ids], bool)
    docs = np.array([d or 0 for d in doc_ids], np.int64)
    parts = [alphabet.tobytes(), docs.tobytes(), null.tobytes(), lengths.astype(np.int64).tobytes()]
    blocks = -(-len(ids) // (8 * BLOCK))
    ranks = np.zeros((bits, blocks + 1), np.int64)
    for p, k in enumerate(range(bits - 1, -1, -1)):
        ones = (now & number.dtype.type(1 << k)) != 0
        plane = np.packbits(ones, bitorder="little")
        if blocks:
            ranks[p, 1:] = np.cumsum(np.add.reduceat(np.bitwise_count(plane), np.arange(0, len(plane), BLOCK), dtype=np.int64))
        parts += [plane[b * BLOCK : (b + 1) * BLOCK].tobytes() for b in range(blocks)]
        now = np.concatenate((now[np.flatnonzero(~ones)], now[np.flatnonzero(ones)]))  # places are faster than masks
    press = zstandard.ZstdCompressor(level=1).compress
    body = [press(x) for x in parts]
    return MAGIC + HEAD.pack(len(ids), len(doc_ids), len(alphabet), bits, blocks) + ranks.tobytes() + np.cumsum([len(x) for x in body]).astype(np.int64).tobytes() + b"".join(body)


class WaveletMatrix:
    """Reads one file; positions count from the shard's first token. Parts are inflated when they are needed."""

    def __init__(self, data: bytes):
        import zstandard

        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        self.data, self._spread = data, zstandard.ZstdDecompressor().decompress
        self.n, self.n_docs, self.n_alphabet, self.bits, self.blocks = HEAD.unpack_from(data, len(MAGIC))
        at = len(MAGIC) + HEAD.size
        #: Ones before each block of each plane; the last entry has all.
        self.ranks = np.frombuffer(data, "<i8", self.bits * (self.blocks + 1), at).reshape(self.bits, -1)
        at += self.ranks.nbytes
        self._ends = np.frombuffer(data, "<i8", 4 + self.bits * self.blocks, at)
        self._base = at + self._ends.nbytes
        self._open: dict[int, np.ndarray] = {}

    def _part(self, k: int) -> bytes:
        first = int(self._ends[k - 1]) if k else 0
        return self._spread(self.data[self._base + first : self._base + int(self._ends[k])])

    def _block(self, plane: int, block: int) -> np.ndarray:
        k = 4 + plane * self.blocks + block
        if k not in self._open:
            if len(self._open) >= OPEN_BLOCKS:
                del self._open[next(iter(self._open))]
            self._open[k] = np.frombuffer(self._part(k), np.uint8)
        return self._open[k]

    @cached_property
    def alphabet(self) -> np.ndarray:
        return np.frombuffer(self._part(0), np.uint32)

    @cached_property
    def doc_ids(self) -> list[int | None]:
        null = np.frombuffer(self._part(2), bool).tolist()
        return [None if x else d for d, x in zip(np.frombuffer(self._part(1), np.int64).tolist(), null)]

    @cached_property
    def lengths(self) -> np.ndarray:
        return np.frombuffer(self._part(3), np.int64)

    def _rank1(self, plane: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block, within = divmod(i, 8 * BLOCK)
        found = int(self.ranks[plane, block])
        if within:
            data = self._block(plane, block)
            found += int(np.bitwise_count(data[: within >> 3]).sum(dtype=np.int64))
            found += (int(data[within >> 3]) & ((1 << (within & 7)) - 1)).bit_count() if within & 7 else 0
        return found

    def _zeros(self, plane: int) -> int:
        return self.n - int(self.ranks[plane, -1])

    def access(self, i: int) -> int:
        """The token at a position."""
        value = 0
        for p in range(self.bits):
            block, within = divmod(i, 8 * BLOCK)
            bit = int(self._block(p, block)[within >> 3] >> (within & 7) & 1)
            ones = self._rank1(p, i)
            i = self._zeros(p) + ones if bit else i - ones
            value = value << 1 | bit
        return int(self.alphabet[value])

    def _range(self, token: int, a: int, b: int) -> tuple[int, int]:
        found = np.flatnonzero(self.alphabet == token)
        if not len(found):
            return 0, 0
        for p in range(self.bits):
            x, y = self._rank1(p, a), self._rank1(p, b)
            a, b = (self._zeros(p) + x, self._zeros(p) + y) if int(found[0]) >> (self.bits - 1 - p) & 1 else (a - x, b - y)
        return a, b

    def count(self, token: int, a: int = 0, b: int | None = None) -> int:
        """How often a token occurs at positions a to b - 1."""
        first, last = self._range(token, a, self.n if b is None else b)
        return last - first

    def select(self, token: int, k: int) -> int:
        """Position of the k-th occurrence, from 0; -1 if there are fewer."""
        first, last = self._range(token, 0, self.n)
        if not 0 <= k < last - first:
            return -1
        i, value = first + k, int(np.flatnonzero(self.alphabet == token)[0])
        for p in range(self.bits - 1, -1, -1):
            one = value >> (self.bits - 1 - p) & 1
            i = self._select_bit(p, one, i - self._zeros(p) if one else i)
        return i

    def _select_bit(self, plane: int, bit: int, k: int) -> int:
        ones = self.ranks[plane]
        before = ones if bit else np.minimum(np.arange(len(ones)) * 8 * BLOCK, self.n) - ones
        block = int(np.searchsorted(before, k, side="right")) - 1
        part = np.unpackbits(self._block(plane, block), bitorder="little")
        return 8 * block * BLOCK + int(np.flatnonzero(part == bit)[k - int(before[block])])

    def decode(self) -> np.ndarray:
        """All tokens in order: planes are undone from the last to the first."""
        kind = np.uint16 if self.n_alphabet <= 1 << 16 else np.uint32
        now = np.zeros(self.n, kind)
        for k, p in enumerate(range(self.bits - 1, -1, -1)):
            data = b"".join(self._part(4 + p * self.blocks + b) for b in range(self.blocks))
            ones = np.unpackbits(np.frombuffer(data, np.uint8), count=self.n, bitorder="little").view(bool)
            zeros = self._zeros(p)
            before = np.empty_like(now)
            before[np.flatnonzero(~ones)] = now[:zeros]
            before[np.flatnonzero(ones)] = now[zeros:] | kind(1 << k)
            now = before
        return self.alphabet[now] if self.n else np.zeros(0, np.uint32)


def write_shards(docs: DataFrame, folder: str, tokenizer_path: str, shard_tokens: int = SHARD_TOKENS) -> None:
    """Writes the shards of all documents, in ascending doc_id order, as a table of files."""
    tokenizer = Path(tokenizer_path).read_bytes()
    ranks, special = ranks_of_json(tokenizer)
    kind = np.uint16 if max([*ranks.values(), *special.values()]) < 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part_no, seq, size = TaskContext.get().partitionId(), 0, 0
        encode = encoder(tokenizer)
        held: list[np.ndarray] = []
        names: list[int | None] = []

        def close() -> pa.RecordBatch:
            lengths = np.array([len(x) for x in held], np.int64)
            row = {"part": [part_no], "seq": [seq], "n_docs": [len(names)], "n_tokens": [size], "payload": [build(np.concatenate(held), names, lengths)]}
            return out_batch(row, {"part": pa.int32(), "seq": pa.int32(), "n_docs": pa.int64(), "n_tokens": pa.int64(), "payload": pa.binary()})

        for batch in batches:
            for part, texts in chunks(batch):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), texts):
                    ids = np.append(encode(text), 0).astype(kind)
                    held.append(ids)
                    names.append(doc_id)
                    size += len(ids)
                    if size >= shard_tokens:
                        yield close()
                        held, names, size, seq = [], [], 0, seq + 1
        if held:
            yield close()

    order = ["doc_id", "tie", "place"]
    dealt = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("place")).repartitionByRange(*order).sortWithinPartitions(*order)
    map_arrow(dealt.select("doc_id", "text"), run, SHARD).write.option("compression", "none").parquet(folder)


def starts_of(spark: SparkSession, folder: str) -> DataFrame:
    """part, seq and first: the tokens before each shard.

    What the driver gathers is one number for each range partition of the writer.
    """
    shards = spark.read.schema(SHARD).parquet(folder)
    totals = {r["part"]: r["n"] for r in shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    base, at = [], 0
    for part in sorted(totals):
        base.append((part, at))
        at += totals[part]
    starts = shards.select("part", "seq", "n_tokens").withColumn("inside", F.sum("n_tokens").over(W.partitionBy("part").orderBy("seq")) - F.col("n_tokens"))
    return starts.join(fits(spark.createDataFrame(base, "part int, base bigint"), len(base)), "part").select("part", "seq", (F.col("base") + F.col("inside")).alias("first"))


def occurrences(spark: SparkSession, folder: str, token: int) -> DataFrame:
    """at: every place of a token over all shards, looked up in the files without decoding them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, payload in zip(*(batch.column(c).to_pylist() for c in ("part", "seq", "payload"))):
                matrix = WaveletMatrix(payload)
                found = np.array([matrix.select(token, k) for k in range(matrix.count(token))], np.int64)
                yield out_batch({"part": [part] * len(found), "seq": [seq] * len(found), "inside": found}, {"part": pa.int32(), "seq": pa.int32()})

    rows = map_arrow(spark.read.schema(SHARD).parquet(folder).select("part", "seq", "payload"), run, "part int, seq int, inside bigint")
    return rows.join(starts_of(spark, folder), ["part", "seq"]).select((F.col("first") + F.col("inside")).alias("at"))


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files in the folder."""
    shards = spark.read.schema(SHARD).parquet(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, payload in zip(*(batch.column(c).to_pylist() for c in ("part", "seq", "payload"))):
                matrix = WaveletMatrix(payload)
                ids = matrix.decode().astype("<u4")
                ends = np.cumsum(matrix.lengths)
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip((ends - matrix.lengths).tolist(), ends.tolist())]
                n = matrix.n_docs
                yield out_batch({"part": [part] * n, "seq": [seq] * n, "doc_id": matrix.doc_ids, "inside": ends - matrix.lengths, "n_tokens": matrix.lengths, "ids_crc32": crcs}, {"part": pa.int32(), "seq": pa.int32(), "doc_id": pa.int64(), "ids_crc32": pa.int64()})

    rows = map_arrow(shards.select("part", "seq", "payload"), run, "part int, seq int, doc_id bigint, inside bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.join(starts_of(spark, folder), ["part", "seq"]).select("doc_id", (F.col("first") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def op6_wavelet_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in wavelet matrix files by byte_bpe_50k.json, read back."""
    import public_tokenizers

    folder = scratch(spark, "wavelet")
    write_shards(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_shards(spark, folder)
