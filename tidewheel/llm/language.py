"""Language identification: script ranges, then Viterbi over the words of a text.

A word's script, from code point ranges, narrows the candidates to languages that use the script.
Each candidate has a log score from hashed character n-grams of the word, counted over all
training rows. The best path over a text's words, with a penalty for each switch, labels
spans, so a mixed text gets a span for each language. The prediction is the language
whose spans hold most letters; the score is its share of all letters.

Ties: of languages with equal letters, and of paths of equal worth, the one whose language comes first in the order of names wins;
staying beats switching. Texts of any length are labelled whole, in time linear in their words.

Defined cases: null texts and texts without a letter are ``und`` with score 0; words without a
letter take the label around them; repeated rows get equal predictions; without training rows
everything is ``und``; an empty table gives an empty result; a null doc_id trains (its hash is null,
so it is not held out) and is kept; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import chunks, map_arrow, out_batch, table, whole_row, with_columns

#: Hash buckets of n-grams, the lengths of n-grams, and the price of a switch in log units.
BUCKETS, LENGTHS, SWITCH = 1 << 15, (1, 2, 3), 12.0
#: A language uses a script if at least this share of its letters is in it.
USES = 0.01
UND = "und"
#: A filter keeps a text if its main language holds at least this share of its letters.
MAIN_SHARE = 0.5

# First and last code points of scripts, from the Unicode block list.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "gurmukhi": [(0xA00, 0xA7F)],
    "gujarati": [(0xA80, 0xAFF)],
    "oriya": [(0xB00, 0xB7F)],
    "tamil": [(0xB80, 0xBFF)],
    "telugu": [(0xC00, 0xC7F)],
    "kannada": [(0xC80, 0xCFF)],
    "malayalam": [(0xD00, 0xD7F)],
    "sinhala": [(0xD80, 0xDFF)],
    "thai": [(0xE00, 0xE7F)],
    "lao": [(0xE80, 0xEFF)],
    "tibetan": [(0xF00, 0xFFF)],
    "myanmar": [(0x1000, 0x109F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "ethiopic": [(0x1200, 0x137F)],
    "khmer": [(0x1780, 0x17FF)],
    "mongolian": [(0x1800, 0x18AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FA1F)],
}
NAMES = [*SCRIPTS, "other"]
_EDGES = sorted((a, b, k) for k, spans in enumerate(SCRIPTS.values()) for a, b in spans)
_STARTS, _ENDS, _KINDS = (np.array(x) for x in zip(*_EDGES))


def scripts_of(points: np.ndarray) -> np.ndarray:
    """Number of the script of each code point; the last one stands for any other."""
    at = np.maximum(np.searchsorted(_STARTS, points, side="right") - 1, 0)
    return np.where((points >= _STARTS[at]) & (points <= _ENDS[at]), _KINDS[at], len(SCRIPTS))


@dataclass
class Distinct:
    """Distinct words of a chunk: letters, main script, and n-gram buckets."""

    letters: np.ndarray
    script: np.ndarray
    bucket: np.ndarray
    word: np.ndarray


def distinct_words(words: list[str]) -> Distinct:
    letters = np.array([sum(map(str.isalpha, w)) if not w.isalpha() else len(w) for w in words], np.int64)
    lower = [w.lower() for w in words]
    lower = [x if x.isalpha() else "".join(filter(str.isalpha, x)) for x in lower]
    joined = " " + " ".join(lower) + " "
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
    gap = points == 32
    owner = np.cumsum(gap) - 1
    at, bucket, word = np.arange(len(points)), [], []
    for n in LENGTHS:
        key = points[: len(points) - n + 1].copy()
        inner = np.zeros(len(key), bool)
        for k in range(1, n):
            key = key * np.uint64(0x9E3779B97F4A7C15) + points[k : len(points) - n + 1 + k]
            if k < n - 1:
                inner |= gap[k : len(points) - n + 1 + k]
        starts, ends = gap[: len(key)], gap[n - 1 :][: len(key)]
        fits = ~inner & ~(starts & ends) if n > 1 else ~starts
        key = key * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(n)
        bucket.append((key * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - (BUCKETS.bit_length() - 1)))[fits].astype(np.int64))
        word.append(owner[at[: len(key)][fits]])
    kinds = scripts_of(points.astype(np.int64))
    votes = np.zeros((len(words), len(NAMES)), np.int64)
    np.add.at(votes, (owner[~gap], kinds[~gap]), 1)
    return Distinct(letters, votes.argmax(axis=1), np.concatenate(bucket), np.concatenate(word))


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # buckets x languages, log probabilities
    allowed: np.ndarray  # scripts x languages


def held_out() -> Column:
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def train(rows: DataFrame) -> Model:
    """Counts n-grams and scripts over all rows with text and lang, by language.

    A task sends one vector for each language it saw; the languages come from the data.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        counts: dict[str, Counter] = {}

        def fold() -> None:
            for lang, c in counts.items():
                d, times = distinct_words(list(c)), np.array(list(c.values()), np.float64)
                mine = total.setdefault(lang, np.zeros(BUCKETS + len(NAMES)))
                mine[:BUCKETS] += np.bincount(d.bucket, times[d.word], BUCKETS)
                mine[BUCKETS:] += np.bincount(d.script, times * d.letters, len(NAMES))
            counts.clear()

        for batch in batches:
            for part, texts in chunks(batch):
                for lang, text in zip(part.column("lang").to_pylist(), texts):
                    if lang is not None and (words := text.split()):
                        counts.setdefault(lang, Counter()).update(words)
                if sum(map(len, counts.values())) > 200_000:
                    fold()
        fold()
        for lang, v in total.items():
            at = np.flatnonzero(v)
            yield out_batch({"lang": [lang] * len(at), "slot": at, "n": v[at].astype(np.int64)}, {"lang": pa.string()})

    sums = map_arrow(rows.select("lang", "text"), run, "lang string, slot bigint, n bigint").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    got = sums.collect()  # at most languages x (BUCKETS + scripts) numbers
    languages = sorted({r["lang"] for r in got})
    counts = np.zeros((BUCKETS + len(NAMES), len(languages)))
    for r in got:
        counts[r["slot"], languages.index(r["lang"])] = r["n"]
    grams, scripts = counts[:BUCKETS] + 0.5, counts[BUCKETS:]
    return Model(languages, np.log(grams / grams.sum(axis=0)), scripts >= USES * np.maximum(scripts.sum(axis=0), 1))


def word_scores(model: Model, d: Distinct) -> np.ndarray:
    """Log score of each word in each language; languages that do not use its script score lowest."""
    n = len(d.letters)
    out = np.stack([np.bincount(d.word, model.weights[d.bucket, k], n) for k in range(len(model.languages))], axis=1)
    out -= out.max(axis=1, keepdims=True)
    allowed = model.allowed[d.script]
    out = np.where(allowed | ~allowed.any(axis=1, keepdims=True), np.maximum(out, -SWITCH), -2 * SWITCH)
    out[d.letters == 0] = 0
    return out


def best_paths(scores: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Viterbi labels of all words of several texts, all texts one step at a time, longest first."""
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    sizes = lengths[order]
    kept = np.empty(scores.shape, bool)
    jump = np.empty(len(scores), np.int8 if scores.shape[1] < 128 else np.int32)
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(longest), side="left")  # texts longer than t
    now = scores[starts[: active[0]]].copy() if longest else scores[:0]
    for t in range(1, longest):
        now = now[: active[t]]
        at = starts[: active[t]] + t
        top = now.argmax(axis=1)
        moved = now[np.arange(len(now)), top][:, None] - switch
        stay = now >= moved
        kept[at], jump[at] = stay, top
        now = np.where(stay, now, moved) + scores[at]
        now -= now.max(axis=1, keepdims=True)
        ended = active[t] - (active[t + 1] if t + 1 < longest else 0)
        if ended:
            jump[starts[active[t] - ended : active[t]]] = now[active[t] - ended :].argmax(axis=1)
    label = np.empty(len(scores), np.int64)
    if longest:
        single = sizes == 1
        state = np.where(single, 0, jump[starts]).astype(np.int64)
        if single.any():
            state[single] = scores[starts[single]].argmax(axis=1)
        for t in range(longest - 1, -1, -1):
            at = starts[: active[t]] + t
            mine = state[: active[t]]
            label[at] = mine
            if t:
                state[: active[t]] = np.where(kept[at, mine], mine, jump[at])
    return label


def steady(scores: np.ndarray, switch: float = SWITCH) -> int:
    """The language of a text whose best path provably never switches, else -1.

    A path that leaves language k gains at most the sum, over the words it is away, of the
    best other score less k's; it pays one switch if it is away at an end of the text, two
    inside. If no stretch gains more than it pays, staying is best.
    """
    k = int(scores.sum(axis=0).argmax())
    if scores.shape[1] == 1:
        return k
    gain = np.delete(scores, k, axis=1).max(axis=1) - scores[:, k]
    total = np.concatenate(([0.0], np.cumsum(gain)))
    low = np.minimum.accumulate(total)
    inside, head, tail = (total - low).max(), total.max(), total[-1] - total.min()
    return k if inside <= 2 * switch and head <= switch and tail <= switch and total[-1] <= 0 else -1


class Labeller:
    """Labels texts; remembers the scores of words it has seen, up to a number of words and of characters."""

    def __init__(self, model: Model, most: int = 200_000, most_chars: int = 4_000_000):
        self.model, self.most, self.most_chars = model, most, most_chars
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.chars = 0
        self.scores = np.zeros((0, len(self.model.languages)))
        self.letters = np.zeros(0, np.int64)

    def spans(self, texts: list[str]) -> list[tuple[list[str], np.ndarray, np.ndarray]]:
        """Words, labels and letter counts of each text."""
        split = [t.split() for t in texts]
        if len(self.index) > self.most or self.chars > self.most_chars:
            self.clear()
        if new := list(set().union(*split).difference(self.index)):
            d = distinct_words(new)
            self.chars += sum(map(len, new))
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
            self.scores = np.concatenate((self.scores, word_scores(self.model, d)))
            self.letters = np.concatenate((self.letters, d.letters))
        ids = [np.fromiter(map(self.index.__getitem__, x), np.int64, len(x)) for x in split]
        out, hard = [], []
        for k, (words, i) in enumerate(zip(split, ids)):
            stay = steady(self.scores[i]) if len(i) else 0
            if stay < 0:
                hard.append(k)
            out.append((words, np.full(len(i), stay), self.letters[i]))
        if hard:
            lengths = np.array([len(ids[k]) for k in hard])
            labels = best_paths(self.scores[np.concatenate([ids[k] for k in hard])], lengths)
            for k, found in zip(hard, np.split(labels, np.cumsum(lengths)[:-1])):
                out[k] = (split[k], found, out[k][2])
        return out


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns in ``keep``, lang_pred, score and spans (the number of labelled spans) of every row."""
    names = np.array([*model.languages, UND], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(model)
        for batch in batches:
            for part, texts in chunks(batch):
                out: dict = {k: part.column(k) for k in keep} | {"lang_pred": [], "score": [], "spans": []}
                for _, labels, letters in labeller.spans(texts) if model.languages else [((), (), np.zeros(0))] * len(texts):
                    total = int(letters.sum())
                    share = np.bincount(labels, letters, len(model.languages)) if total else np.zeros(1)
                    out["lang_pred"].append(names[share.argmax()] if total else UND)
                    out["score"].append(float(share.max() / total) if total else 0.0)
                    out["spans"].append(int((np.diff(labels) != 0).sum()) + 1 if total else 0)
                yield out_batch(out, {"lang_pred": pa.string(), "score": pa.float64(), "spans": pa.int64()})

    return map_arrow(docs.select(*dict.fromkeys([*keep, "text"])), run, with_columns(docs, keep, "lang_pred string, score double, spans bigint"))


def keep_known(docs: DataFrame, main_share: float = MAIN_SHARE) -> DataFrame:
    """The rows of docs that have a main language; learns from all rows with a language."""
    model = train(docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()))
    given = docs.select(whole_row(docs), "text")
    return predict(given, model, ["row"]).where((F.col("lang_pred") != UND) & (F.col("score") >= main_share)).select("row.*")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()))
    return predict(docs.withColumn("held_out", held_out()), model, ["doc_id", "held_out"])
