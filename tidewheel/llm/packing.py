"""Packing documents into fixed-length sequences by a linear grouping scheme.

Long lengths are sorted and cut into groups of equal cardinality; each is rounded up to its
group's largest. With so few sizes, the best mix of configurations (multisets of sizes that
fit a sequence) comes from a linear program by column generation. Actual documents
then take the rounded slots, and what is left - short documents, and those that rounding
the program to whole numbers leaves over - goes best-fit, longest first, into the
room that remains.

All of this needs only the histogram of lengths: at most ``capacity`` numbers, whatever the
size of the corpus. The driver turns it into a plan of index ranges (so many documents
of a length go to such a run of sequences), whose size is bounded by capacity and group
count; it is broadcast, and Spark places documents by their rank within their length.

Two shares of a sequence are tried as the bound of long lengths: just under a half, where a configuration can hold two
long sizes, and a half, where it holds one and short documents fill the rest. The plan with fewer sequences is used.

Defined cases: null and empty texts pack as the end id alone; repeated rows are separate
documents; texts of any length are cut into whole pieces, the first the shorter one; an
empty table gives an empty result; a null doc_id is kept; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .bpe import encoder
from .common import chunks, fits, map_arrow, materialize, numbered, out_batch, small_table, table

#: Groups of long lengths, and the shares of a sequence above which a length is long.
GROUPS, LONG_SHARES = 400, (0.45, 0.5)
#: Columns that the linear program may generate, against endless degenerate steps; a plan that stops there is right, but may need more sequences.
STEPS = 20_000
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces_of(docs: DataFrame, tokenizer_path: str, capacity: int) -> DataFrame:
    """Every document's ids with the end id 0, cut into pieces; only the first may be shorter than the rest."""
    tokenizer = Path(tokenizer_path).read_bytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            for part, texts in chunks(batch):
                out: dict[str, list[int]] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
                for doc_id, text in zip(part.column("doc_id").to_pylist(), texts):
                    ids = np.append(encode(text), 0).astype("<u4")
                    cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        for name, v in zip(out, (doc_id, k, a, b - a, zlib.crc32(ids[a:b]))):
                            out[name].append(v)
                yield out_batch(out, {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()})

    return map_arrow(docs.select("doc_id", "text"), run, PIECES)


def best_configuration(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes of the highest total worth that fits; sizes are long, so it has few members."""
    best, picks = np.zeros(capacity + 1), []
    useful = np.flatnonzero(worth > 1e-12)
    for _ in range(capacity // int(sizes.min())):
        after, pick = best.copy(), np.full(capacity + 1, -1)
        for g in useful:
            s = sizes[g]
            gain = best[: capacity + 1 - s] + worth[g]
            better = gain > after[s:] + 1e-12
            after[s:][better], pick[s:][better] = gain[better], g
        picks.append(pick)
        if (pick < 0).all():
            break
        best = after
    counts, room = np.zeros(len(sizes), np.int64), capacity
    for pick in reversed(picks):
        if (g := pick[room]) >= 0:
            counts[g] += 1
            room -= sizes[g]
    return float(worth @ counts), counts


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, most: int = STEPS) -> list[tuple[int, np.ndarray]]:
    """Whole multiplicities of configurations, rounded down from the linear program's optimum."""
    k = len(sizes)
    columns = np.diag(capacity // sizes).astype(float)
    inverse = np.diag(1 / np.diag(columns))
    for step in range(most):
        value, entering = best_configuration(sizes, inverse.sum(axis=0), capacity)
        if value <= 1 + 1e-7:
            break
        along, now = (inverse * entering).sum(axis=1), (inverse * demand).sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(along > 1e-9, now / along, np.inf)
        leave = int(ratio.argmin())
        columns[:, leave] = entering
        inverse = _inverse(columns) if step % 50 == 49 else _pivot(inverse, along, leave)
    times = np.floor(np.maximum((_inverse(columns) * demand).sum(axis=1), 0) + 1e-6).astype(np.int64)
    return [(int(times[c]), columns[:, c].astype(np.int64)) for c in range(k) if times[c]]


def _pivot(inverse: np.ndarray, along: np.ndarray, row: int) -> np.ndarray:
    out = inverse - np.outer(along, inverse[row] / along[row])
    out[row] = inverse[row] / along[row]
    return out


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """By elimination in numpy alone: threads of a LAPACK inside the driver process can block each other."""
    k = len(matrix)
    both = np.hstack((matrix, np.eye(k)))
    for c in range(k):
        best = c + int(np.abs(both[c:, c]).argmax())
        both[[c, best]] = both[[best, c]]
        both[c] /= both[c, c]
        other = both[:, c].copy()
        other[c] = 0
        both -= np.outer(other, both[c])
    return both[:, k:]


class Plan:
    """Index ranges of lengths and the runs of sequences they go to."""

    def __init__(self, capacity: int):
        self.capacity, self.sequences = capacity, 0
        self.rows: list[dict] = []
        self.used: dict[int, int] = defaultdict(int)  # of each length, how many are placed
        self.events: dict[int, int] = defaultdict(int)  # change of load from this sequence on

    def place(self, length: int, count: int, first: int, each: int, skip: int = 0) -> None:
        """The next ``count`` documents of a length: ``each`` to a sequence from ``first`` on, after ``skip`` places."""
        i = self.used[length]
        self.rows.append({"length": length, "i0": i, "i1": i + count, "first": first, "each": each, "skip": skip})
        self.used[length] = i + count
        done = 0
        while done < count:  # at most three runs: the rest of a sequence, whole ones, part of one
            at, inside = first + (skip + done) // each, (skip + done) % each
            n = min(each - inside, count - done)
            runs = (count - done) // each if inside == 0 and count - done >= each else 1
            self.events[at] += length * n
            self.events[at + runs] -= length * n
            done += n * runs

    def room(self) -> list[list[tuple[int, int]]]:
        """For each remaining room, the runs (first, count) of sequences that have it."""
        free: list[list[tuple[int, int]]] = [[] for _ in range(self.capacity + 1)]
        load, at = 0, 0
        for b in sorted({*self.events, self.sequences}):
            if b > at:
                free[self.capacity - load].append((at, b - at))
            load, at = load + self.events.get(b, 0), b
        return free


def make_plan(histogram: dict[int, int], capacity: int, groups: int = GROUPS, long_shares: tuple[float, ...] = LONG_SHARES) -> Plan:
    """The plan with the fewest sequences; of equals, the one with more long lengths."""
    plans = [_plan(histogram, capacity, groups, x) for x in long_shares]
    return min(plans, key=lambda p: p.sequences)


def _plan(histogram: dict[int, int], capacity: int, groups: int, long_share: float) -> Plan:
    plan = Plan(capacity)
    if full := histogram.get(capacity, 0):
        plan.sequences += full
        plan.place(capacity, full, 0, 1)
    long = [(s, n) for s, n in sorted(histogram.items(), reverse=True) if long_share * capacity < s < capacity]
    if long:
        _place_long(plan, long, groups)
    _place_rest(plan, {s: n - plan.used[s] for s, n in histogram.items()})
    return plan


def _place_long(plan: Plan, long: list[tuple[int, int]], groups: int) -> None:
    lengths, ends = np.array([s for s, _ in long]), np.cumsum([n for _, n in long])
    total = int(ends[-1])
    cuts = np.unique(np.arange(groups + 1) * total // groups)
    sizes = lengths[np.searchsorted(ends, cuts[:-1], side="right")]
    mixes = configurations(sizes, np.diff(cuts).astype(float), plan.capacity)
    left = cuts[:-1].copy()
    runs = []
    for times, counts in mixes:
        for g in np.flatnonzero(counts):
            n = int(min(times * counts[g], cuts[g + 1] - left[g]))
            if n:
                runs.append((int(left[g]), n, plan.sequences, int(counts[g])))
                left[g] += n
        plan.sequences += times
    for at, n, first, each in sorted(runs):  # by rank, so that each length's documents are taken in order
        end, skip = at + n, 0
        while at < end:
            k = int(np.searchsorted(ends, at, side="right"))
            # a length's index counts only those placed; what a group leaves over comes after them
            count = min(int(ends[k]), end) - at
            plan.place(int(lengths[k]), count, first, each, skip)
            at, skip = at + count, skip + count


def _place_rest(plan: Plan, counts: dict[int, int]) -> None:
    """Best-fit, longest first, over whole runs of equal documents and equal sequences."""
    free = plan.room()
    for s in sorted((s for s, n in counts.items() if n), reverse=True):
        n, room = counts[s], s
        while n:
            while room <= plan.capacity and not free[room]:
                room += 1
            if room > plan.capacity:
                first, have, room = plan.sequences, -(-n // (plan.capacity // s)), plan.capacity
                plan.sequences += have
            else:
                first, have = free[room].pop()
            each = min(room // s, n)
            runs = min(have, n // each)
            plan.place(s, each * runs, first, each)
            n -= each * runs
            free[room - each * s].append((first, runs))
            if have > runs:
                free[room].append((first + runs, have - runs))


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048) -> DataFrame:
    """Every piece with its sequence and its gapless offset there."""
    spark = docs.sparkSession
    pieces = materialize(pieces_of(docs, tokenizer_path, capacity).withColumn("place", F.monotonically_increasing_id()), "pieces")
    counts = materialize(pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.collect()}
    plan = make_plan(histogram, capacity)
    ranges = small_table(spark, plan.rows, "length bigint, i0 bigint, i1 bigint, first bigint, each bigint, skip bigint")
    ranked = numbered(pieces, "length", counts, len(histogram), sum(histogram.values()))
    placed = ranked.join(fits(ranges, len(plan.rows)), "length").where("idx >= i0 and idx < i1")
    placed = placed.withColumn("sequence_id", F.col("first") + F.expr("(idx - i0 + skip) div each"))
    before = W.partitionBy("sequence_id").orderBy(F.col("length").desc(), F.col("doc_id").asc_nulls_first(), "piece", "idx")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", (F.sum("length").over(before.rowsBetween(W.unboundedPreceding, 0)) - F.col("length")).alias("offset"))


def op2_linear_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 ids of byte_bpe_50k.json."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
