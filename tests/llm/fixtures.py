"""A small documents table with the hard cases, and helpers."""

TEXTS = [
    "the quick brown fox jumps over the lazy dog " * 12,
    "THE quick brown fox jumps over the lazy dog " * 12,
    "the quick brown fox jumps over the lazy dog " * 12,
    "",
    None,
    None,
    "!!! ### 123 456",
    "été à la plage, où était-ce ?\nété à la plage, où était-ce ?\n\n \t\nfin",
    "漢字 かな 한국어 mixed with English words 🙂🙂",
    "a",
    "a b c",
    "<|endoftext|> inside <s> and </s>\x00 null byte\x0b\x0c\x1c\x85 ",
    " ".join(f"w{i}" for i in range(6000)),
    "x" * 30000,
    "line one\nline two\nline one\nLine one\n   \nline two",
]
EXTRA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, digest string, score double, `part` int, keep_id bigint, `odd name.x` string"


def documents(spark, texts=TEXTS, ids=None):
    """Rows with extra columns whose names the operators use inside; a null id and a repeated row among them."""
    ids = list(range(len(texts))) if ids is None else ids
    langs = ["en", "fr", None]
    rows = [(i, t, langs[k % 3], f"s{k % 2}", len(t or ""), "r", "d", 0.5, 1, 7, "o") for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, EXTRA)


def hard(spark):
    """TEXTS, then a row without an id and one row twice."""
    return documents(spark, [*TEXTS, "no id here", "a b c"], [*range(len(TEXTS)), None, 10])


def empty(spark):
    return documents(spark, [], [])
