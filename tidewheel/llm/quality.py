"""Quality rules: base counts of a text and a hashed n-gram log-likelihood ratio.

Tokens (runs of letters, digits and characters beyond ASCII; runs of other signs) and pairs of
neighbours are hashed into buckets, all tokens of a chunk of texts at once. One multinomial is counted over the trusted target (documents labelled good),
one over every document of the raw corpus. A document's score is its mean log ratio, target over
raw, for each n-gram; it is kept if the score reaches the threshold and no base rule fails. There
is no draw: every document gets the same verdict in every run.

The threshold has the least balanced error on the labelled documents, each good one scored as if
the target lacked it, so that a few wrong labels of either kind do not move it into the other kind.

The raw counts cover all documents, the target all documents labelled good, and the threshold all
labelled documents; nothing is sampled. Counts reach the driver as one vector of buckets. Labels meet the texts
in one shuffle, and meet scores by doc_id; the threshold is found by ranks within bins of the score, so nothing on the driver grows with the corpus.

Defined cases: a null or empty text has no words, all counts zero, and fails the base rule; without
labels of both kinds the ratio decides nothing and only base rules do; repeated rows are
judged alike; a score equal to the threshold is kept; texts of any length are counted whole, about CHUNK_CHARS characters at once besides
one text; an empty table gives an empty result; a null doc_id has no label; extra
columns are ignored by the counts and kept by the filter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import chunks, map_arrow, out_batch, table, whole_row, with_columns

BUCKETS = 1 << 14
#: Bins of a score's unit, in which scores are ranked: so many that no bin holds a large share of them.
BINS = 1 << 14
#: The share of all bad labelled documents that base rules and threshold together must reject.
REJECT_LEAST = 0.5
# The signs that count as symbols, and the characters between words.
SYMBOLS, SPACES = "#*$%&|<>", " \t\n\x0b\x0c\r"
MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
BASE = 0x5851F42D4C957F2D
#: Of each byte: 0 between words, 1 in a word, 2 another sign.
KIND = np.array([0 if chr(b) in SPACES else 1 if b > 127 or chr(b).isalnum() else 2 for b in range(256)], np.uint8)


class Powers:
    """Powers of the hash base and of its inverse, as far as any chunk has needed."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << n.bit_length()
            inverse = pow(BASE, -1, 1 << 64)
            cls.up, cls.down = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)))) for x in (BASE, inverse))
        return cls.up, cls.down


class Hashed:
    """Hashes of the words and tokens of several texts; the same for equal strings in any chunk."""

    def __init__(self, texts: list[str]):
        raw = [t.encode() for t in texts]
        data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
        edges = np.cumsum([0, *(len(r) + 1 for r in raw)])
        kind = KIND[data]
        before = np.concatenate((np.zeros(1, np.uint8), kind[:-1]))
        after = np.concatenate((kind[1:], np.zeros(1, np.uint8)))
        up, self.down = Powers.of(len(data) + 1)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])))
        inside = kind != 0
        self.words = self._of(np.flatnonzero(inside & (before == 0)), np.flatnonzero(inside & (after == 0)) + 1)
        self.word_cuts = np.searchsorted(np.flatnonzero(inside & (before == 0)), edges)
        starts = np.flatnonzero(inside & (before != kind))
        self.tokens = self._of(starts, np.flatnonzero(inside & (after != kind)) + 1)
        self.token_cuts = np.searchsorted(starts, edges)

    def _of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self.sums[ends] - self.sums[starts]) * self.down[starts]
        h = (h ^ h >> np.uint64(32)) * MIX_A
        return (h ^ h >> np.uint64(29)) * MIX_B

    def grams(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Bucket and text number of every token and every pair of neighbours."""
        doc = np.repeat(np.arange(len(self.token_cuts) - 1), np.diff(self.token_cuts))
        same = doc[1:] == doc[:-1]
        pair = (self.tokens[:-1] * MIX_A ^ self.tokens[1:] * MIX_B)[same]
        bucket = np.concatenate((self.tokens, pair)) * MIX_A >> np.uint64(64 - (buckets.bit_length() - 1))
        return bucket.astype(np.int64), np.concatenate((doc, doc[1:][same]))

    def words_of(self, k: int) -> np.ndarray:
        return self.words[self.word_cuts[k] : self.word_cuts[k + 1]]


def repeated(text: str, words: np.ndarray) -> int:
    """Words in windows of three that stand twice or more in the text, given the words' hashes.

    Hashes only find windows that may repeat; whether they do is told by the words themselves.
    """
    if len(words) < 4:
        return 0
    keys = words[:-2] * MIX_A ^ (words[1:-1] + MIX_A) * MIX_B ^ words[2:]
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    own, at = text.encode().split(), np.flatnonzero(np.isin(keys, twice)).tolist()
    times = Counter((own[i], own[i + 1], own[i + 2]) for i in at)
    covered = np.zeros(len(words), bool)
    for i in at:
        if times[own[i], own[i + 1], own[i + 2]] > 1:
            covered[i : i + 3] = True
    return int(covered.sum())


def base_counts(text: str, words: np.ndarray) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines and n_repeat_words of one text."""
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated(text, words)


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Counts of every bucket over all rows; each task sends one vector, and Spark sums them by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, texts in chunks(batch):
                total += np.bincount(Hashed(texts).grams(buckets)[0], minlength=buckets)
        yield out_batch({"bucket": np.arange(buckets), "n": total}, {})

    out = np.zeros(buckets, np.int64)
    for r in map_arrow(docs.select("text"), run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def held_out(bucket: np.ndarray, doc: np.ndarray, good: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What the score of each text changes by if the target's counts lack the text; nothing unless it is good."""
    out, size = np.zeros(len(good)), target.sum() + len(target) / 2
    order = np.argsort(doc, kind="stable")
    cuts = np.searchsorted(doc[order], np.arange(len(good) + 1))
    for k in np.flatnonzero(good & (np.diff(cuts) > 0)):
        own, n = np.unique(bucket[order[cuts[k] : cuts[k + 1]]], return_counts=True)
        less = np.log(np.maximum(target[own] - n, 0) + 0.5) - np.log(target[own] + 0.5)  # of a text that is in the target, n is at most the target's
        out[k] = (n * less).sum() / n.sum() + np.log(size / max(size - n.sum(), 0.5))
    return out


def judged(docs: DataFrame, ratio: np.ndarray, keep: list[str], target: np.ndarray | None = None) -> DataFrame:
    """The columns in ``keep``, the base counts and the score of every row; given the target's counts, also what the score is if they lack the row (``held``)."""
    buckets = len(ratio)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch):
                hashed = Hashed(texts)
                bucket, doc = hashed.grams(buckets)
                n = np.bincount(doc, minlength=len(texts))
                score = np.bincount(doc, ratio[bucket], len(texts)) / np.maximum(n, 1)
                out = {k: part.column(k) for k in keep}
                base = np.array([base_counts(t, hashed.words_of(k)) for k, t in enumerate(texts)], np.int64)
                out |= {"n_words": np.diff(hashed.word_cuts)} | dict(zip(names[1:], base.T))
                out |= {"score": score}
                if target is not None:
                    out |= {"held": score + held_out(bucket, doc, np.ones(len(texts), bool), target)}
                yield out_batch(out, {})

    more = ", ".join([*(f"{k} bigint" for k in names), "score double", *(["held double"] if target is not None else [])])
    return map_arrow(docs.select(*dict.fromkeys([*keep, "text"])), run, with_columns(docs, keep, more))


def fit(docs: DataFrame, labels: DataFrame, reject_least: float = REJECT_LEAST, buckets: int = BUCKETS) -> tuple[np.ndarray, float]:
    """Log ratio of each bucket and the threshold, from all documents and all labels."""
    usable = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    if usable.select("quality").distinct().count() < 2:
        return np.zeros(buckets), -1.0
    marked = docs.select("doc_id", "text").hint("merge").join(usable.where("quality = 1"), "doc_id")  # labels grow with the corpus
    raw, target = bucket_counts(docs, buckets), bucket_counts(marked, buckets)
    if not target.sum() or target.sum() == raw.sum():
        return np.zeros(buckets), -1.0
    ratio = np.log((target + 0.5) / (target.sum() + buckets / 2)) - np.log((raw + 0.5) / (raw.sum() + buckets / 2))
    scored = judged(docs, ratio, ["doc_id"], target).select("doc_id", "score", "held", base_failed().alias("failed")).join(usable, "doc_id")
    return ratio, threshold_of(scored.select("quality", F.when(F.col("quality") == 1, F.col("held")).otherwise(F.col("score")).alias("score"), "failed"), reject_least)


def threshold_of(scored: DataFrame, reject_least: float = REJECT_LEAST) -> float:
    """What ``threshold`` gives for rows of quality, score and failed, worked out in Spark.

    The counts below a score are those of lower bins and those within its own; the bins are few, whatever the number of rows.
    """
    passed = F.when(~F.col("failed"), F.col("score"))
    at = scored.groupBy(passed.alias("score")).agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad")).persist()
    try:
        known = F.col("score").isNotNull()
        n = at.agg(*(F.coalesce(F.sum(F.when(c, F.col(k))), F.lit(0)).alias(a) for a, k, c in (("good", "good", known), ("bad", "bad", known), ("failed", "bad", ~known))), F.max("score").alias("top")).first()
        if not n["good"]:
            return -1e9
        binned = at.where(known).withColumn("bin", F.floor(F.col("score") * BINS))
        lower = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        bins = binned.groupBy("bin").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.max("score").alias("last"))
        bins = bins.select("bin", F.sum("good").over(lower).alias("good0"), F.sum("bad").over(lower).alias("bad0"), F.max("last").over(lower).alias("last0"))
        own = Window.partitionBy("bin").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
        before = lambda k: F.coalesce(F.col(f"{k}0"), F.lit(0)) + F.coalesce(F.sum(k).over(own), F.lit(0))
        cuts = binned.join(bins, "bin").select("score", before("good").alias("below"), before("bad").alias("under"), F.coalesce(F.max("score").over(own), "last0").alias("previous"))
        gap = F.coalesce(F.col("score") - F.col("previous"), F.lit(2.0))  # the first cut lies 1 below all scores
        error = F.col("below") / F.lit(n["good"]) + (1 - F.col("under") / F.lit(max(1, n["bad"])))
        cuts = cuts.where(F.lit(n["failed"]) + F.col("under") >= F.lit(reject_least * (n["failed"] + n["bad"]))).select("score", gap.alias("gap"), error.alias("error"))
        least = cuts.agg(F.min("error")).first()[0]
        if least is None:
            return n["top"] + 1
        best = cuts.where(F.col("error") <= least + 1e-12).agg(F.max_by(F.struct("score", "gap"), F.struct("gap", -F.col("score")))).first()[0]
        return best["score"] - best["gap"] / 2
    finally:
        at.unpersist()


def threshold(good: np.ndarray, bad: np.ndarray, failed: int, reject_least: float = REJECT_LEAST) -> float:
    """The cut with the least sum of the shares of good scores below it and of bad ones above it.

    Only cuts count that leave at least ``reject_least`` of all bad documents out, with the ``failed`` ones that the base
    rules have rejected. Of equals, the middle of the widest gap between two scores is taken.
    """
    if not len(good):
        return -1e9
    good, bad = np.sort(good), np.sort(bad)
    at = np.unique(np.concatenate((good, bad)))
    gap = np.concatenate(([2.0], np.diff(at)))  # the first cut lies 1 below all scores
    below, under = np.searchsorted(good, at), np.searchsorted(bad, at)  # at[k] is the lowest score that is kept
    error = below / len(good) + (1 - under / max(1, len(bad)))
    enough = failed + under >= reject_least * (failed + len(bad))
    if not enough.any():
        return float(at[-1] + 1)
    error = np.where(enough, error, np.inf)
    k = max(np.flatnonzero(error <= error.min() + 1e-12), key=lambda i: gap[i])
    return float(at[k] - gap[k] / 2)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def quality_rules(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Columns of ``keep``, base counts, score, base_failed and kept of every document."""
    ratio, threshold = fit(docs, labels)
    out = judged(docs, ratio, keep or ["doc_id"])
    return out.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep."""
    given = docs.select(whole_row(docs), "doc_id", "text")
    return quality_rules(given, labels, ["row"]).where("kept").select("row.*")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict for every document, target and threshold from ``labels``."""
    out = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
