"""Sharding, counts, encoders, exact dedup and packing against brute force."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tidewheel.llm import bpe, packing, piece_bpe, radix_dedup, sharding, token_counts, wavelet
from tidewheel.llm.common import scratch

from . import fixtures

JSON = public_tokenizers.path("byte_bpe_50k.json")
MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
TABLES = ["hard", "empty"]


def of(spark, name):
    df = getattr(fixtures, name)(spark)
    return df, [(r["doc_id"], r["text"] or "") for r in df.collect()]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(JSON)


def ids_of(library, text):
    return library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", TABLES)
def test_sharding(spark, name):
    docs, rows = of(spark, name)
    folder = scratch(spark, "map")
    out = sharding.shard(docs, 3, folder).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == Counter((i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in rows)
    for h in {r["shard"] for r in out}:
        places = sorted(r["slot"] for r in out if r["shard"] == h)
        assert places == list(range(len(places)))
    if rows:
        grown = sharding.shard(docs, 4, folder, version=2, last_version=1).collect()
        assert {r["virtual_slot"] for r in grown} == {r["virtual_slot"] for r in out}


def copies(spark, n=100_000):
    """One row many times, another without an id, and some others."""
    hot = spark.range(n).selectExpr("7L AS doc_id", "'the same row again and again' AS text")
    null = spark.range(n // 10).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "'THE same row again and again' AS text")
    return hot.unionByName(null).unionByName(spark.range(2000).selectExpr("id + 100 AS doc_id", "concat('text ', id, repeat(' x', int(id % 300))) AS text"))


def test_copies_of_a_row_spread_over_slots(spark):
    docs, folder = copies(spark), scratch(spark, "map")
    out = sharding.shard(docs, 8, folder).toPandas()
    size = out.groupby("shard")["size"].sum()
    assert len(out) == docs.count() and len(size) == 8 and size.max() - size.min() < 0.01 * size.mean()
    assert out[out.doc_id == 7].groupby("virtual_slot").size().max() < 100
    assert all((g == range(len(g))).all() for _, g in out.sort_values("slot").groupby("shard").slot)
    again = sharding.shard(docs.repartition(5), 8, scratch(spark, "map")).toPandas()
    assert Counter(zip(out.doc_id.fillna(-1), out.virtual_slot)) == Counter(zip(again.doc_id.fillna(-1), again.virtual_slot))


def test_map_versions(spark):
    docs, folder = fixtures.hard(spark), scratch(spark, "map")
    sharding.shard(docs, 3, folder)
    first = sharding.load_map(spark, folder, 1)
    assert set(first) == set(range(sharding.SLOTS)) and max(Counter(first.values()).values()) < 0.4 * sharding.SLOTS
    with pytest.raises(Exception, match="(?i)exist"):
        sharding.shard(docs, 4, folder)
    assert sharding.load_map(spark, folder, 1) == first


def test_copies_of_a_row_are_one_group(spark):
    docs = copies(spark)
    out = radix_dedup.exact_dedup(docs).groupBy("keep_id", "group_size").agg(F.count(F.lit(1)).alias("n"), F.count_if("kept").alias("kept")).collect()
    found = {(r["keep_id"], r["group_size"]): (r["n"], r["kept"]) for r in out}
    assert found.pop((7, 110_000)) == (110_000, 1)
    assert len(found) == 2000 and set(found.values()) == {(1, 1)}


def test_copies_of_a_row_are_packed_and_stored(spark):
    docs = copies(spark)
    packed = packing.pack(docs, JSON, 256).toPandas()
    assert (packed.piece == 0).sum() == docs.count() and (packed.groupby("sequence_id")["length"].sum() <= 256).all()
    hot = packed[packed.doc_id == 7]["length"].iloc[0]  # most are of one length, whose multiples leave a gap
    assert packed.sequence_id.nunique() <= packed["length"].sum() / (256 // hot * hot) + 1
    folder = scratch(spark, "wavelet")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few bytes would be put into one task
    try:
        wavelet.write_shards(docs, folder, JSON, 20_000)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    out = wavelet.read_shards(spark, folder).toPandas().sort_values("start")
    assert len(out) == docs.count() and (out.start.to_numpy() == np.cumsum(out.n_tokens) - out.n_tokens).all()
    parts = spark.read.schema(wavelet.SHARD).parquet(folder).groupBy("part").agg(F.sum("n_docs").alias("n")).toPandas().n
    assert parts.max() < 0.5 * parts.sum()


def test_map_edits():
    rng = np.random.default_rng(0)
    totals = {s: (int(b), 1) for s, b in enumerate(rng.integers(1, 1000, 4096))}
    load = lambda m, n: np.bincount(list(m.values()), [totals[s][0] for s in m], n)
    one = sharding.edit_map(totals, 8)
    assert np.ptp(load(one, 8)) <= 0.001 * load(one, 8).mean() + 1
    grown = sharding.edit_map(totals, 9, one)
    assert np.ptp(load(grown, 9)) <= 0.002 * load(grown, 9).mean()
    assert sum(grown[s] != one[s] for s in one) < 0.2 * len(one)
    moved = Counter(grown[s] for s in one if grown[s] != one[s])
    assert moved[8] > 0.8 * moved.total()  # the rest evens out the last bytes
    shrunk = sharding.edit_map(totals, 7, one)
    assert max(shrunk.values()) == 6


@pytest.mark.parametrize("name", TABLES)
def test_token_counts(spark, name):
    import sentencepiece

    docs, rows = of(spark, name)
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = Counter((i, len(t.encode()), len(model.encode(t)), len(model.encode(t)) > 4096) for i, t in rows)
    cache = scratch(spark, "cache")
    for _ in range(2):  # the second run encodes nothing
        got = token_counts.token_counts(docs, cache, PIECES).collect()
        assert Counter(tuple(r) for r in got) == want
    assert spark.read.schema(token_counts.CACHE).parquet(cache).count() == len({t for _, t in rows})


@pytest.mark.parametrize("name", TABLES)
def test_piece_bpe(spark, name):
    import tiktoken

    docs, rows = of(spark, name)
    ranks = bpe.read_ranks(open(MULTI, "rb").read())
    coder = tiktoken.Encoding("multi", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter()
    for i, t in rows:
        ids = coder.encode_ordinary(t)
        want[(i, len(ids), sha(",".join(map(str, ids)).encode()), sha(t.encode()))] += 1
    assert Counter(tuple(r) for r in piece_bpe.round_trip(docs, MULTI).collect()) == want


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_piece_bpe_texts(text):
    import tiktoken

    own = piece_bpe.codec(open(MULTI, "rb").read())
    coder = tiktoken.Encoding("multi", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    ids = own.encode(text)
    assert ids == coder.encode_ordinary(text) and own.decode(ids).decode() == text


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_fast_encoding_texts(library, text):
    assert bpe.encode_ids(open(JSON, "rb").read(), text).tolist() == ids_of(library, text)


def test_fast_encoding_every_character(library):
    data = open(JSON, "rb").read()
    points = [c for c in [*range(0x30000), *range(0x30000, 0x110000, 61)] if not 0xD800 <= c <= 0xDFFF]
    for at in range(0, len(points), 3000):
        texts = [f"a{chr(c)}1 {chr(c)}{chr(c)} b" for c in points[at : at + 3000]]
        for text, e in zip(texts, library.encode_batch_fast(texts, add_special_tokens=False)):
            assert bpe.encode_ids(data, text).tolist() == e.ids, text


def test_fast_encoding_whole_vocabulary(library):
    data = open(JSON, "rb").read()
    pieces = [p.decode("utf-8", "ignore") for p in bpe.ranks_of_json(data)[0]]
    texts = [f"{p}{q} {p}" for p, q in zip(pieces, pieces[1:] + pieces[:1])] + pieces
    for text, e in zip(texts, library.encode_batch_fast(texts, add_special_tokens=False)):
        assert bpe.encode_ids(data, text).tolist() == e.ids, text


@pytest.mark.parametrize("digit", [1, 64])
@pytest.mark.parametrize("name", TABLES)
def test_radix_dedup(spark, name, digit):
    docs, rows = of(spark, name)
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    out = radix_dedup.exact_dedup(docs, first_digit=digit).collect()
    want = Counter()
    for t, ids in groups.items():
        top = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[(i, top, len(ids), hashlib.sha256(t.encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in out) == want
    assert sum(r["kept"] for r in out) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in out if r["kept"])
    assert radix_dedup.keep_one(docs).columns == docs.columns and radix_dedup.keep_one(docs).count() == len(groups)


@pytest.mark.parametrize("name", TABLES)
def test_packing(spark, library, name):
    docs, rows = of(spark, name)
    out = packing.pack(docs, JSON, 2048).collect()
    want = Counter()
    for i, t in rows:
        ids = np.array([*ids_of(library, t), 0], "<u4")
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(i, k, a, b - a, zlib.crc32(ids[a:b]))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    bins = defaultdict(list)
    for r in out:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in bins.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= 2048


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 200), max_size=40), st.sampled_from([4, 96]))
def test_plans(histogram, groups):
    plan = packing.make_plan(histogram, 64, groups)
    load, placed = np.zeros(plan.sequences, int), Counter()
    for r in plan.rows:
        assert r["i0"] == placed[r["length"]]
        placed[r["length"]] = r["i1"]
        np.add.at(load, r["first"] + (np.arange(r["i1"] - r["i0"]) + r["skip"]) // r["each"], r["length"])
    assert placed == Counter(histogram) and (not len(load) or load.min() > 0 and load.max() <= 64)


@pytest.mark.parametrize("seed", range(6))
def test_plan_needs_the_fewest(seed):
    """With short documents to fill gaps, no more sequences than the volume needs."""
    rng = np.random.default_rng(seed)
    sizes, counts = np.unique(np.clip(rng.lognormal(5 + seed / 5, 1.2, 12000).astype(int), 1, 2048), return_counts=True)
    plan = packing.make_plan(dict(zip(sizes.tolist(), counts.tolist())), 2048)
    assert plan.sequences <= -(-int((sizes * counts).sum()) // 2048) + 1


def test_plan_is_close():
    rng = np.random.default_rng(1)
    sizes, counts = np.unique(np.clip(rng.lognormal(6.2, 1, 60000).astype(int), 1, 2048), return_counts=True)
    plan = packing.make_plan(dict(zip(sizes.tolist(), counts.tolist())), 2048)
    assert plan.sequences <= 1.01 * (sizes * counts).sum() / 2048


@pytest.mark.parametrize("name", TABLES)
def test_wavelet(spark, library, name):
    docs, rows = of(spark, name)
    folder = scratch(spark, "wavelet")
    wavelet.write_shards(docs, folder, JSON, 5000)
    out = sorted(wavelet.read_shards(spark, folder).collect(), key=lambda r: r["start"])
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in out) == Counter((i, len(ids_of(library, t)) + 1, zlib.crc32(np.array([*ids_of(library, t), 0], "<u4"))) for i, t in rows)
    at = 0
    for r in out:
        assert r["start"] == at
        at += r["n_tokens"]
    keys = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in out]
    assert keys == sorted(keys)
    every = [t for _, text in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)) for t in [*ids_of(library, text), 0]]
    for token in (0, 262, 50_000_000):
        assert wavelet.occurrences(spark, folder, token).count() == every.count(token)
    ends = {r["start"] + r["n_tokens"] - 1 for r in out}
    assert ends <= {r["at"] for r in wavelet.occurrences(spark, folder, 0).collect()}


@pytest.mark.parametrize("n, kinds", [(0, 1), (1, 1), (5, 3), (1000, 7), (5000, 300), (513, 2), (1024, 5), (8 * wavelet.BLOCK, 3), (300_001, 900)])
def test_rank_and_select(n, kinds):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % kinds).astype(np.uint16)
    matrix = wavelet.WaveletMatrix(wavelet.build(ids, [1, None], np.array([n // 2, n - n // 2])))
    assert (matrix.decode() == ids).all() and matrix.doc_ids == [1, None]
    for i in rng.integers(0, n, min(n, 40)) if n else []:
        assert matrix.access(int(i)) == ids[i]
    for token in range(min(kinds, 6)):
        a, b = sorted(rng.integers(0, n + 1, 2).tolist())
        assert matrix.count(token, a, b) == (ids[a:b] == token).sum()
        places = np.flatnonzero(ids == token)
        assert [matrix.select(token, k) for k in range(0, len(places), 97)] == places[::97].tolist()
        assert matrix.select(token, len(places)) == -1
    if n > 2:  # one access inflates one block of each plane at most
        fresh = wavelet.WaveletMatrix(wavelet.build(ids, [1], np.array([n])))
        assert fresh.access(n - 2) == ids[n - 2] and len(fresh._open) <= 2 * fresh.bits
