"""SimHash near-duplicates: pigeonhole blocks, verified Hamming distance, connected components.

A fingerprint has a bit for each of the 64 bit positions that are set in over half of the
document's shingle hashes. The bits are split into d + 1 blocks, so that two fingerprints that differ in at most d bits agree on a
block, and meet in its bucket. A crowded bucket is split in the same way by d + 1 blocks of the bits that it does not fix, and so on,
a few times; only its own fingerprints get more keys, and every split finds the same links.

Equal fingerprints are one node. A bucket that is still crowded is compared in tiles of bounded size, pair of
tiles by pair of tiles, each in its own row; a tile pair reports a spanning forest of
its links, never all pairs. So no bucket is capped and none is held by one task. Components come
from alternating star contraction with a table written in each round.

Defined cases: null texts and texts without words have fingerprint zero and link like any
other; a bit set in exactly half of the hashes is 0; a text of any length is hashed whole, its shingles in parts of bounded size;
repeated rows share a node; an empty table gives an empty result; a null
doc_id gets the smallest non-null id of its component, or null; of rows that share the smallest id of a component the filter keeps one; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import map_arrow, materialize, out_batch, small_batches, table, whole_row

SEED, BITS = 42, 64
#: Fingerprints in a tile; a pair of tiles is compared at once.
TILE = 1024
#: Fingerprints of a bucket beyond which it is split, and how often at most.
CROWD, SPLITS = 1024, 2


def fingerprint(text: str, words_each: int) -> int:
    """SimHash of the shingles of one text, as an unsigned integer."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words_each, len(words))
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())
    hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in spans], dtype="<u8")
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        bits = np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words_each: int = 4, carry: bool = False) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long; with carry also ``row``, all columns of the input row, which stay in the JVM."""
    small_batches(docs.sparkSession)

    @F.arrow_udf("long")
    def fp(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t, words_each) if t else 0 for t in (x.as_py() for x in texts)], dtype=np.uint64).view(np.int64))

    return docs.select(*[whole_row(docs)] * carry, "doc_id", fp(F.col("text")).alias("fp"))


def signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def block_masks(distance: int, fixed: int = 0) -> list[int]:
    """The masks of d + 1 blocks of the bits that are not fixed, each with the fixed bits."""
    free = [k for k in range(BITS) if not fixed >> k & 1]
    edges = [round(i * len(free) / (distance + 1)) for i in range(distance + 2)]
    return [fixed | sum(1 << k for k in free[a:b]) for a, b in zip(edges, edges[1:])]


def forest(tile: np.ndarray, other: np.ndarray | None, distance: int) -> list[tuple[int, int]]:
    """Links within a tile, or between two, thinned to a spanning forest of that tile pair."""
    nodes = tile if other is None else np.concatenate((tile, other))
    label, links = np.arange(len(nodes)), []
    for i in range(len(tile)):
        at = i + 1 if other is None else len(tile)
        near = np.flatnonzero(np.bitwise_count(nodes[at:] ^ nodes[i]) <= distance) + at
        for j in near[label[near] != label[i]].tolist():
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                links.append((int(nodes[i]), int(nodes[j])))
    return links


def buckets(fps: DataFrame, distance: int, crowd: int, splits: int) -> DataFrame:
    """mask, bits, n and fp: the fingerprints of every bucket of more than one, buckets beyond ``crowd`` split as often as allowed."""
    done, masks, members = [], [0], fps.select("fp", F.lit(0).cast("long").alias("mask"))
    for level in range(splits + 1):
        parts = {m: block_masks(distance, m) for m in masks}
        masks = [x for m in masks for x in parts[m]]
        wide = F.create_map(*[x for m, p in parts.items() for x in (F.lit(signed(m)), F.array(*[F.lit(signed(y)) for y in p]))])
        keyed = members.select("fp", F.explode(wide[F.col("mask")]).alias("mask")).withColumn("bits", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = materialize(keyed.groupBy("mask", "bits").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "crowds")
        # written, so that Spark can split a crowded bucket in the joins that follow
        met = materialize(keyed.join(sizes, ["mask", "bits"]), "met")
        done.append(met if level == splits else met.where(F.col("n") <= crowd))
        members = met.where(F.col("n") > crowd).select("fp", "mask")
        if level == splits or members.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def links_of(fps: DataFrame, distance: int = 4, crowd: int = CROWD, splits: int = SPLITS) -> DataFrame:
    """a, b: links between distinct fingerprints that give the same components as all links.

    fps has one row for each distinct fingerprint (fp)."""
    met = buckets(fps, distance, crowd, splits).withColumn("tiles", F.ceil(F.col("n") / TILE).cast("int"))
    met = met.withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    pairs = F.expr("transform(sequence(0, tiles - 1), t -> struct(least(t, mine) as i, greatest(t, mine) as j))")
    rows = met.select("mask", "bits", "fp", "mine", F.explode(pairs).alias("p")).select("mask", "bits", "fp", "mine", "p.i", "p.j")
    packed = rows.groupBy("mask", "bits", "i", "j").agg(F.collect_list(F.when(F.col("mine") == F.col("i"), F.col("fp"))).alias("left"), F.collect_list(F.when(F.col("mine") != F.col("i"), F.col("fp"))).alias("right"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: set[tuple[int, int]] = set()
            one = [np.array(x, dtype=np.int64).view(np.uint64) for x in batch.column("left").to_pylist()]
            two = [np.array(x, dtype=np.int64).view(np.uint64) for x in batch.column("right").to_pylist()]
            for i, j, a, b in zip(batch.column("i").to_pylist(), batch.column("j").to_pylist(), one, two):
                found.update(forest(a, None if i == j else b, distance))
            ends = np.array(sorted(found), dtype=np.uint64).reshape(-1, 2).view(np.int64)
            yield out_batch({"a": pa.array(ends[:, 0]), "b": pa.array(ends[:, 1])}, {})

    return map_arrow(packed.select("i", "j", "left", "right"), run, "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of each component of the edges (a, b).

    Alternating large-star and small-star contraction; every round is written, its
    groups are reduced to a minimum before the shuffle. A join's reduced side is written
    first, so that Spark can split the other side where a hub makes it skewed.
    """
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    while True:
        near = both(edges)
        low = materialize(near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "lows")
        large = materialize(near.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        least = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        met = large.join(least, "a")
        small = met.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        after = materialize(small, "stars")
        if after.count() == edges.count() and after.exceptAll(edges).isEmpty():
            return after.select(F.col("a").alias("node"), F.col("b").alias("root"))
        edges = after


def named_prints(prints: DataFrame, distance: int) -> DataFrame:
    """fp, root (its component) and component_id (the component's smallest doc_id) of each distinct fingerprint."""
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    roots = components(links_of(nodes.select("fp"), distance))
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    lowest = materialize(placed.groupBy("root").agg(F.min("first").alias("component_id")), "lowest")
    return materialize(placed.join(lowest, "root").select("fp", "root", "component_id"), "named")


def near_duplicates(docs: DataFrame, words_each: int = 4, distance: int = 4) -> DataFrame:
    """doc_id, fingerprint and component_id of every row."""
    prints = materialize(fingerprints(docs, words_each), "fingerprints")
    named = named_prints(prints, distance).select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words_each: int = 4, distance: int = 4) -> DataFrame:
    """The rows of docs, one of each component: one with the smallest doc_id."""
    prints = materialize(fingerprints(docs, words_each, carry=True).withColumn("place", F.monotonically_increasing_id()), "fingerprints")
    named = named_prints(prints.select("doc_id", "fp"), distance).select("fp", "root")
    # ids order nulls last, so that a row without an id stays only where no other is
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "place")
    stay = prints.select("doc_id", "fp", "place").join(named, "fp").groupBy("root").agg(F.min_by("place", order).alias("place"))
    # the same join at every size: whether places would fit a broadcast says nothing about the corpus
    return prints.join(materialize(stay.select("place"), "stay").hint("merge"), "place", "left_semi").select("row.*")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: 4-word shingles, 4 bits."""
    return near_duplicates(table(spark, sf_dir, "documents"))
