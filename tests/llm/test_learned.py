"""Quality, language, near-duplicates, pages and the pipeline against brute force and held-out rows."""

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tidewheel.llm import html_text, language, quality, registry, simhash

from . import fixtures

DATA = "/root/testdata/sf0.001"
TABLES = ["hard", "empty"]


def of(spark, name):
    df = getattr(fixtures, name)(spark)
    return df, [(r["doc_id"], r["text"] or "") for r in df.collect()]


def counts_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("name", TABLES)
def test_quality_counts(spark, name):
    docs, rows = of(spark, name)
    labels = spark.createDataFrame([(0, 1, 0), (6, 0, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    out = quality.quality_rules(docs, labels).collect()
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in out)
    want = Counter()
    for i, t in rows:
        c = counts_of(t)
        want[(i, *c, c[0] < 50 or 100 * c[4] > 50 * c[0])] += 1
    assert got == want and not any(r["kept"] and r["base_failed"] for r in out)
    none = quality.quality_rules(docs, labels.limit(0)).collect()
    assert all(r["kept"] != r["base_failed"] for r in none)
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_quality_ratio(spark):
    """The ratio of every bucket equals a count by hand, and labels are told apart."""
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    ratio, threshold = quality.fit(docs, labels)
    good = {r["doc_id"] for r in labels.collect() if r["quality"] == 1}
    raw, target = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS)
    for r in docs.collect():
        bucket, _ = quality.Hashed([r["text"] or ""]).grams(quality.BUCKETS)
        n = np.bincount(bucket, minlength=quality.BUCKETS)
        raw += n
        target += n * (r["doc_id"] in good)
    want = np.log((target + 0.5) / (target.sum() + quality.BUCKETS / 2)) - np.log((raw + 0.5) / (raw.sum() + quality.BUCKETS / 2))
    assert np.allclose(ratio, want)
    out = quality.quality_rules(docs, labels).join(labels, "doc_id").collect()
    sound = [r for r in out if r["quality"] == 1 and not r["base_failed"]]
    assert sum(r["kept"] for r in sound) >= 0.99 * len(sound)
    assert sum(r["kept"] for r in out if r["quality"] == 0) <= 0.1 * max(1, sum(r["quality"] == 0 for r in out))


def test_quality_uses_every_label(spark):
    """more labels than 5000 of a kind; all good texts are the target, and all scores set the threshold as the plain function does."""
    rows = [(k, f"good{k % 97} alpha beta{k}", 1) for k in range(6500)] + [(k, f"junk{k % 89} click buy{k}", 0) for k in range(6500, 12500)]
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, q) for k, _, q in rows], "doc_id bigint, quality int")
    ratio, _ = quality.fit(docs, labels)
    counts = lambda texts: np.bincount(quality.Hashed(texts).grams(quality.BUCKETS)[0], minlength=quality.BUCKETS)
    raw, target = counts([t for _, t, _ in rows]), counts([t for _, t, q in rows if q])
    assert np.allclose(ratio, np.log((target + 0.5) / (target.sum() + quality.BUCKETS / 2)) - np.log((raw + 0.5) / (raw.sum() + quality.BUCKETS / 2)))


@pytest.mark.parametrize("seed", range(6))
def test_threshold_in_spark(spark, seed):
    """the distributed threshold is the plain one, with equal scores, negative ones, failed rows and one kind missing."""
    rng = np.random.default_rng(seed)
    places = 1 if seed % 2 else 3
    good, bad = rng.normal(0.3, 1, [200, 50, 1, 0, 40, 300][seed]).round(places), rng.normal(-0.3, 1, [150, 0, 30, 20, 40, 3][seed]).round(places)
    failed = [0, 5, 2, 3, 60, 0][seed]
    rows = [(1, float(x), False) for x in good] + [(0, float(x), False) for x in bad] + [(0, 9.0, True)] * failed + [(1, 8.0, True)]
    got = quality.threshold_of(spark.createDataFrame(rows, "quality int, score double, failed boolean"))
    assert got == quality.threshold(good, bad, failed)


@pytest.mark.parametrize("junk_as_good, good_as_junk", [(0, 0), (1, 0), (4, 0), (0, 4), (4, 4)])
def test_quality_with_wrong_labels(spark, junk_as_good, good_as_junk):
    """A few labels are wrong; documents without a label are judged as if none were."""
    rng = random.Random(5)
    words, noise = [f"word{k}" for k in range(300)], [f"zx{k}q" for k in range(300)]
    texts = [" ".join(rng.choices(words if k < 300 else noise, k=80) + rng.choices(noise if k < 300 else words, k=rng.randint(0, 25))) for k in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    marks = [(k, int((k < 300) != (k % 150 < good_as_junk and k < 150 or 300 <= k < 300 + junk_as_good)), 0) for k in range(400) if k < 150 or 300 <= k < 350]
    kept = {r["doc_id"] for r in quality.keep_good(docs, spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")).collect()}
    assert len(kept & set(range(150, 300))) >= 148 and len(kept & set(range(350, 400))) <= 1


def test_threshold():
    assert quality.threshold(np.array([1.0, 2.0]), np.array([-3.0, -1.0]), 0) == 0
    assert quality.threshold(np.array([1.0, 2.0]), np.array([]), 3) == 0
    assert quality.threshold(np.array([]), np.array([1.0]), 0) == -1e9
    assert quality.threshold(np.array([-5.0, *range(1, 100)]), np.array([-3.0, -1.0, 50.0]), 0) == 0
    assert quality.threshold(np.arange(4.0), np.array([3.5, 4.0]), 0) == 3.75  # half of the bad labels must go
    assert quality.threshold(np.arange(4.0), np.array([3.5, 4.0]), 2) == -1


def test_held_out():
    """As a count without the text gives it."""
    rng = np.random.default_rng(2)
    bucket, doc = rng.integers(0, 16, 60), np.repeat([0, 1, 2], 20)
    target = np.bincount(bucket, minlength=16) + 3
    got = quality.held_out(bucket, doc, np.array([True, False, True]), target)
    for k in range(3):
        own = bucket[doc == k]
        less = target - np.bincount(own, minlength=16)
        log = lambda t: np.log((t + 0.5) / (t.sum() + 8))
        assert np.isclose(got[k], 0 if k == 1 else (log(less) - log(target))[own].mean())


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    out = registry.QUERIES["op9_language_id"](spark, "/root/testdata/sf0.01").join(docs, "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in out]) > 0.98 and all(0 <= r["score"] <= 1 for r in out)


@pytest.mark.parametrize("name", TABLES)
def test_language_cases(spark, name):
    docs, rows = of(spark, name)
    model = language.train(docs.where("lang is not null and text is not null"))
    out = language.predict(docs, model, ["doc_id"]).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(i for i, _ in rows)
    for r in out:
        text = dict(rows).get(r["doc_id"], "")
        assert (r["lang_pred"] == "und") == (not any(map(str.isalpha, text)))
    assert language.keep_known(docs).columns == docs.columns


def test_mixed_text_has_spans(spark):
    words = {"en": "the cat sat with that other thing while they were there", "de": "der hund ging durch die schöne straße und blieb nicht stehen"}
    train = spark.createDataFrame([(k, v + " " + w, k) for k, w in words.items() for v in [w] * 30], "source string, text string, lang string")
    model = language.train(train)
    got = language.Labeller(model).spans([words["en"] * 1 + " " + words["de"]])[0]
    names = [model.languages[k] for k in got[1]]
    assert names[:8] == ["en"] * 8 and names[-8:] == ["de"] * 8


@pytest.mark.parametrize("seed", range(40))
def test_viterbi(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 15, rng.integers(1, 8))
    scores = rng.normal(size=(lengths.sum(), 3)) * 2

    def worth(s, path):
        return s[np.arange(len(path)), path].sum() - 1.5 * (np.diff(path) != 0).sum()

    at, labels = 0, language.best_paths(scores, lengths, 1.5)
    for n in lengths:
        s = scores[at : at + n]
        best = s[0].copy()
        for t in range(1, n):
            best = np.maximum(best, best.max() - 1.5) + s[t]
        assert abs(worth(s, labels[at : at + n]) - best.max()) < 1e-9
        if (k := language.steady(s, 1.5)) >= 0:
            assert worth(s, np.full(n, k)) >= best.max() - 1e-9
        at += n


def brute_print(text, k=4):
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def brute_components(prints, distance=4):
    nodes = sorted(set(prints))
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if (a ^ b).bit_count() <= distance:
                root[find(b)] = find(a)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("name", TABLES)
def test_simhash(spark, name):
    docs, rows = of(spark, name)
    prints = [brute_print(t) for _, t in rows]
    root = brute_components(prints)
    low = {}
    for (i, _), p in zip(rows, prints):
        if i is not None:
            low[root[p]] = min(i, low.get(root[p], i))
    want = Counter((i, f"{p:016x}", low.get(root[p])) for (i, _), p in zip(rows, prints))
    assert Counter(tuple(r) for r in simhash.near_duplicates(docs).collect()) == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(root.values()))


@pytest.mark.parametrize("tile, crowd", [(4, 8), (1024, 1024), (16, 1024)])
def test_dense_and_chained_fingerprints(spark, monkeypatch, tile, crowd):
    """Chains of links and a dense ball, over many tiles and in one, with crowded buckets split and not."""
    rng = random.Random(3)
    prints = []
    for _ in range(60):
        p = rng.getrandbits(64)
        for _ in range(rng.randint(1, 8)):
            prints.append(p)
            for _ in range(rng.randint(1, 6)):
                p ^= 1 << rng.randrange(64)
    ball = rng.getrandbits(64)
    prints += [ball ^ sum(1 << b for b in rng.sample(range(12), rng.randint(0, 5))) for _ in range(150)]
    monkeypatch.setattr(simhash, "TILE", tile)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in set(prints)]
    got = {r["node"]: r["root"] for r in simhash.components(simhash.links_of(spark.createDataFrame(signed, "fp bigint"), crowd=crowd)).collect()}
    groups = {}
    for p, r in brute_components(prints).items():
        groups.setdefault(r, set()).add(p - (1 << 64) if p >> 63 else p)
    mine = {}
    for (n,) in signed:
        mine.setdefault(got.get(n, n), set()).add(n)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, groups.values()))


@pytest.mark.parametrize("seed", range(3))
def test_keys_miss_no_pair(seed):
    """However often buckets are split, two fingerprints that differ in four bits agree on a mask."""
    rng, fixed = random.Random(seed), [0]
    for _ in range(simhash.SPLITS + 1):
        fixed = [m for f in fixed for m in simhash.block_masks(4, f)]
        for _ in range(300):
            x = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(not x & m for m in fixed)


def test_pages_on_fixture(spark):
    page = "<html><head><title>T</title></head><body><div><a>Home</a> <a>News</a></div><div class=ad>Buy</div><div><h1>{0}</h1><p>One &amp; {0}<p>two\n  three<br>four {0}</div><div id=comments><p>bad</p></div><div>Contact us</div></body></html>"
    rows = [(i, f"http://h.example/{i}", page.format(f"t{i}")) for i in range(6)] + [(7, None, None), (8, "http://x/1", ""), (9, "http://y/1", page.format("solo")), (9, "http://y/1", page.format("solo")), (None, "bad url", "<p>x")]
    pages = spark.createDataFrame([(*r, "e", "k") for r in rows], "page_id bigint, url string, html string, host string, own string")
    want = {i: f"t{i}\n\nOne & t{i}\n\ntwo three four t{i}" for i in range(6)} | {7: "", 8: "", None: "x"}
    for limit in (html_text.BROADCAST_KEYS, -1):  # broadcast, and the join beyond it
        got = html_text.extract(pages, broadcast_keys=limit).collect()
        assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
        found = {r["page_id"]: r["text"] for r in got}
        assert {k: found[k] for k in want} == want
        assert found[9] == "Home News\n\nsolo\n\nOne & solo\n\ntwo three four solo\n\nContact us"  # no recurrence to go by
    assert html_text.extract(pages.limit(0)).count() == 0


def test_copies_of_a_page_are_no_template(spark):
    html = "<body><div><h1>Same</h1><p>text of a copied page</p></div></body>"
    pages = spark.createDataFrame([(i, "http://h/x", html) for i in range(20)], "page_id bigint, url string, html string")
    assert {r["text"] for r in html_text.extract(pages).collect()} == {"Same\n\ntext of a copied page"}


@pytest.mark.parametrize("article", [True, False])
@pytest.mark.parametrize("limit", [html_text.BROADCAST_KEYS, -1])
def test_near_copies_keep_their_text(spark, article, limit):
    """Five near copies among twenty pages share passages and lists; what half of the host's pages have goes."""
    shared = "<div><p>A passage of a notice.</p></div><ul><li>one</li><li>two</li></ul><p>Its end.</p>"
    box = "<article>{}</article>" if article else "{}"
    page = "<body><div>Home News</div><div>" + box + "</div><div>Contact</div></body>"
    rows = [(i, f"http://h/{i}", page.format(f"<h1>Copy {i}</h1>{shared}" if i < 5 else f"<p>Own text {i}</p>")) for i in range(20)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string"), broadcast_keys=limit).collect()}
    tail = "A passage of a notice.\n\none\n\ntwo\n\nIts end."
    assert got == {i: f"Copy {i}\n\n{tail}" if i < 5 else f"Own text {i}" for i in range(20)}


def test_one_article_under_many_addresses(spark):
    """Only text outside the article differs: the article and its list stay, a box in it and an article of boxes only do not."""
    page = "<body><div>page {0} of 9</div><div><main><div>Buy now</div><h1>Title</h1><ul><li>one</li></ul><p>Text</p></main></div></body>"
    empty = "<body><main><div>Buy now</div></main><div>Real text {0}</div></body>"
    rows = [(i, f"http://h/{i}", (page if i < 9 else empty).format(i)) for i in range(12)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {i: "Title\n\none\n\nText" if i < 9 else f"Real text {i}" for i in range(12)}


SLUGS = ["<h2 id='related-work'>{}</h2>", "<h2 id=social-history class=share>{}</h2>", "<section id='notice-of-appeal'>{}</section>", "<section class='related-work' id=search>{}</section>", "<p id=comment class='skip-none'>{}</p>", "<ol><li id=login>{}</li></ol>"]
BOXES = ["<div class='share-price'>{}</div>", "<div id='social-history'>{}</div>"]


@pytest.mark.parametrize("part", SLUGS + BOXES)
def test_slugs_mark_no_text(part):
    for tag in ("article", "main", "body"):
        source = f"<body><{tag}><h1>T</h1>{part.format('kept')}<div class='share'>gone</div><div class='box related'>gone</div></{tag}>"
        assert html_text.main_text(source)[0] == "T\n\nkept"
    assert html_text.main_text("<div id=site-nav>gone</div><div role=search>gone</div><p>kept")[0] == "kept"


@pytest.mark.parametrize("start", ["<body><div>", "<div>", "<p>", "", "<b></b>", "<br>", "<svg></svg>", "<body><main>", "<noscript>n</noscript><link rel=x><p>"])
def test_head_left_open(start):
    """Whatever cannot stand in a head ends it; what can stays out of the text."""
    source = f"<html><head><title>t</title><meta charset=utf-8><style>s</style>\n{start}Text <i>of</i> the page"
    assert html_text.main_text(source)[0] == "Text of the page"
    assert html_text.main_text("<head><title>t</title></head><body><p>Text")[0] == "Text"


def test_pages_without_head_end(spark):
    page = "<!doctype html><html><head><title>x</title><body><div>Home</div><p>Text {0}<p>More {0}</html>"
    pages = spark.createDataFrame([(i, f"http://h/{i}", page.format(f"t{i}")) for i in range(6)], "page_id bigint, url string, html string")
    assert {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()} == {i: f"Text t{i}\n\nMore t{i}" for i in range(6)}


MALFORMED = {
    '<div class="a"">one</div><p>two': "one\n\ntwo",
    "<p>one <a href=it's>two</a> three": "one two three",
    '<div title="open><p>one</p><a href="x">two</a>': "one\n\ntwo",
    "<p title='open>one</p><p>two": "one\n\ntwo",
    '<p>one<img alt="a > b" src=x> two <b c="1"d="2">three</b>': "one two three",
    "<p>1 < 2 <3 &lt;b&gt; </> </ x> end": "1 < 2 <3 <b> end",
    "<p>one<!-- c --> two<!--> three<!-- open <p>four": "one two three\n\nfour",
    "<body><title>open<p>one</p>": "open\n\none",
    "<p>one<script>var t = '<p>';</script> two": "one\n\ntwo",
    "<p>one</div></nav></p><p>two</b>": "one\n\ntwo",
    "<article><p>a <math>b</math> <label>c</label></article>": "a b c",
}


@pytest.mark.parametrize("source", MALFORMED)
def test_bad_tags_lose_no_more_than_themselves(source):
    assert html_text.main_text(source)[0] == MALFORMED[source]


@pytest.mark.parametrize("part", ["<div>", "<a ", "<p title='x", "<!-- x >", "<title>", "</p>", "<div></nav>", "<li><div><blockquote></li>"])
def test_long_pages_take_linear_time(part):
    import time

    def seconds(n):
        began = time.perf_counter()
        html_text.main_text(part * n + "<p>end")
        return time.perf_counter() - began

    seconds(2000)
    assert seconds(80_000) < 16 * max(seconds(20_000), 0.02)


@pytest.mark.parametrize("box", ['<div id="comments">{}</div>', '<section class="post comments">{}</section>', '<div class="disqus"><div>{}</div></div>'])
def test_comments_may_hold_articles(box):
    source = "<body><div class=sidebar><article><h1>Story</h1>{}</article></div>{}</body>"
    said = "<article class=comment><p>first!</article>"
    assert html_text.main_text(source.format("", box.format(said)))[0] == "Story"
    assert html_text.main_text(source.format(box.format(said), ""))[0] == "Story"


def many_pages():
    """Two hosts whose parts carry no telling tag or class: menus in five texts, an advert that never recurs, and near copies."""
    page = "<body><div><span>Menu {m} of</span> {h}</div><div class=c><h1>T {k}</h1><p>Text {k}</p>{same}</div><table><tr><td>Imprint of {h}</table></body>"
    same = "<div class=q><p>A passage that some pages share.</p></div>"
    rows = [(k, f"https://{h}/{k}", page.format(m=k % 5, h=h, k=f"{h}{k}", same=same if k % 6 == 0 else "")) for h in ("a.example", "b.example") for k in range(30)]
    return rows + [(100 + k, "https://c.example/x", page.format(m=0, h="c", k=k, same="")) for k in range(3)]


def test_templates_are_counted_as_by_hand(spark):
    rows = many_pages()
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {(r["site"], r["slot"], r["key"]): r["pages"] for r in html_text.counted(pages.withColumn("host", html_text.host_of(F.col("url")))).collect()}
    bodies, hosts = {}, Counter()
    for _, url, source in rows:
        site = html_text.hash_of(url.split("/")[2])
        body, own = html_text.page_keys(source, site)
        for slot, key in [(0, site), *own]:
            bodies.setdefault((site, slot, key), set()).add(body)
    want = {k: len(v) for k, v in bodies.items() if len(v) >= 4}
    assert got == want
    site = {k[0]: n for k, n in want.items() if k[0] == k[2] and k[1] == 0}
    for (s, slot, key), n in want.items():
        hosts[s, slot] += n if slot else 0
    brute = {k[2] for k, n in want.items() if k[2] != k[0] and (2 * n >= site[k[0]] if k[1] == 0 else 2 * hosts[k[:2]] >= site[k[0]])}
    assert {r["key"] for r in html_text.templates(pages.withColumn("host", html_text.host_of(F.col("url")))).collect()} == brute
    # read from the markup: each host has the imprint (alone and in its slot, as table, row and cell are one wrapper) and five menus in one slot
    assert sum(k[1] == 0 for k in want if k[2] in brute) == 2 and len(brute) == 2 * (1 + 1 + 5)


@pytest.mark.parametrize("limit", [html_text.BROADCAST_KEYS, -1])
def test_templates_without_telling_names(spark, limit):
    rows = many_pages()
    out = html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string"), broadcast_keys=limit).collect()
    want = Counter()
    for k, url, _ in rows:
        h = url.split("/")[2]
        if h == "c.example":  # three pages show nothing
            want[(k, f"Menu 0 of c\n\nT {k - 100}\n\nText {k - 100}\n\nImprint of c", 0)] += 1
        else:
            want[(k, f"T {h}{k}\n\nText {h}{k}" + ("\n\nA passage that some pages share." if k % 6 == 0 else ""), 2)] += 1
    assert Counter((r["page_id"], r["text"], r["n_template"]) for r in out) == want


def test_recurrence_finds_templates_in_testdata(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    assert html_text.templates(pages.withColumn("host", html_text.host_of(F.col("url")))).count() > 0
    assert registry.QUERIES["op8_site_templates"](spark, "/root/testdata/sf0.01").agg(F.sum("n_template")).first()[0] > 0


def test_pages_of_testdata(spark):
    import html

    sources = {r["page_id"]: r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    for r in registry.QUERIES["op8_site_templates"](spark, "/root/testdata/sf0.01").collect():
        article = re.search(r"<article>(.*)</article>", sources[r["page_id"]], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", b))).split()) for b in re.split(r"</?p>|</?h\d>", article)]
        assert r["text"] == "\n\n".join(b for b in blocks if b)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, steps[-1], DATA)
        assert out.columns == docs.columns, name
        path = corpus_pipeline.materialize(out, "test")
        assert path.exceptAll(steps[-1]).isEmpty()
        steps.append(path)
    texts = [r["text"] for r in steps[3].collect()]
    lower = [t.encode().lower() for t in texts]
    assert len(set(lower)) == len(lower)
    prints = [brute_print(r["text"]) for r in steps[4].collect()]
    root = brute_components(prints)
    assert len(set(root.values())) == len(prints)
    assert len(prints) == len(set(brute_components([brute_print(t) for t in texts]).values()))
    packed = corpus_pipeline.run(spark, DATA)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == {r["doc_id"] for r in steps[4].collect()}


def test_runs_do_not_touch_each_other(spark):
    """Two runs are built and then read; so are two calls of each stage that drops duplicates."""
    one, two = (corpus_pipeline.run(spark, DATA) for _ in range(2))
    assert sorted(map(tuple, one.select("doc_id", "piece", "length").collect())) == sorted(map(tuple, two.select("doc_id", "piece", "length").collect()))
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[2:4]:
        first, second = stage(spark, docs, DATA), stage(spark, docs.where("doc_id % 2 = 0"), DATA)
        few, many = second.count(), first.count()
        assert 0 < few <= many


def test_pipeline_of_nothing(spark, tmp_path):
    none = fixtures.empty(spark)
    none.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_radix_oracle(spark):
    import duckdb

    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    got = registry.QUERIES["op5_radix_dedup"](spark, DATA)
    names = sorted(got.columns)
    want = duck.execute(f"SELECT {', '.join(names)} FROM ({registry.ORACLES['op5_radix_dedup']})").fetchall()
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want)


def test_op1_law(spark):
    out = registry.QUERIES["op1_virtual_slots"](spark, "/root/testdata/sf0.01")
    sizes = [r["b"] for r in out.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) < 0.01 * max(sizes)
