"""Exact deduplication by distributed MSD radix partitioning.

Rows are split by successive bytes of their normalised text (A-Z lower-cased, null as
empty). A pass takes the next digit of bytes of every row that is still in question and groups by
(group so far, digit). Groups of one row leave; groups whose text has ended are equal texts and
leave; the rest go on at the next offset. Digits grow eightfold, so texts of n bytes need
O(log n) passes and each byte moves once. No digest decides equality.

Groups are counted before the shuffle, so a huge group is one row there. Rows find their
group by a join, in which a group with over a thousandth of the bytes in question is dealt over several parts. Each pass is written to a scratch table, with a place for each row; of the rows of a
group that share its largest doc_id, the one at the least place stays, found by a partial aggregate.

Defined cases: null and empty texts are equal, and end in the first pass; a text of any length is read to its end, in as many passes
as its digits need; a null doc_id loses to any other, and stays null if all of the group are null; if rows
repeat a doc_id with equal text, keep_id is that id and exactly one of them is kept; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import materialize, table, whole_row

#: Bytes of the first digit and the factor from one digit to the next.
FIRST_DIGIT, GROWTH, WIDEST = 64, 8, 1 << 24
#: A group with over a PARTS-th of the bytes in question is split; fewer than PARTS groups can be so large.
PARTS = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def dealt(cut: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with ``part``: the rows of a large group are dealt over parts, and the group stands in each of them, at most once a row.

    The hash only says which rows are dealt; groups that share a large one's are dealt like it.
    """
    spot = F.xxhash64("gid", "digit").alias("spot")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    share = F.least(F.ceil(F.col("bytes") * PARTS / F.lit(total)), F.col("n"))
    large = groups.where(F.col("bytes") * PARTS > F.lit(total)).groupBy(spot).agg(F.max(share).cast("long").alias("ways"))
    ways = F.coalesce("ways", F.lit(1).cast("long"))
    # fewer than PARTS rows of two numbers, whatever the corpus
    rows = cut.withColumn("spot", spot).join(F.broadcast(large), "spot", "left")
    each = groups.withColumn("spot", spot).join(F.broadcast(large), "spot", "left")
    rows = rows.withColumn("part", F.pmod(F.monotonically_increasing_id(), ways))
    return rows.drop("spot", "ways"), each.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), ways - 1))).drop("spot", "ways", "bytes")


def groups_of(docs: DataFrame, carry: bool = False, first_digit: int = FIRST_DIGIT, growth: int = GROWTH) -> DataFrame:
    """doc_id, text_sha256, keep_id and group_size of every row; keep_id is the group's largest doc_id.

    pass, gid and place name the row's last pass, its group there and itself. With carry, ``row`` holds all columns of the input row,
    under names that cannot clash with these, and there is no text_sha256.
    """
    own = ["row", "doc_id"] if carry else ["doc_id", "text_sha256"]
    # rows that are carried hold their text already; others carry what is left of it
    text = lambda column: F.encode(F.translate(F.coalesce(column, F.lit("")), UPPER, LOWER), "UTF-8")
    rest = [] if carry else ["rest"]
    size = F.coalesce(F.octet_length("row.text" if carry else "rest"), F.lit(0)).cast("long") + 64  # with the row's other columns
    start = [whole_row(docs), "doc_id"] if carry else [text("text").alias("rest"), "doc_id", F.sha2(text("text"), 256).alias("text_sha256")]
    rows = docs.select(*start, F.lit(0).cast("long").alias("gid"))
    done, width, offset = [], first_digit, 0
    while True:
        cut = rows.withColumn("digit", F.substring(text("row.text"), offset + 1, width) if carry else F.substring("rest", 1, width))
        groups = cut.groupBy("gid", "digit").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("top"), F.sum(size).alias("bytes")).where("n > 1")
        groups = materialize(groups.withColumn("next", F.monotonically_increasing_id()), "radix-groups")
        cut, groups = dealt(cut, groups)
        # the same join at every size: whether groups would fit a broadcast says nothing about the corpus
        met = cut.join(groups.hint("merge"), ["gid", "digit", "part"], "left")
        ended = F.octet_length("digit") < width  # a text that fills its digit goes on, and ends with an empty one
        single = F.col("n").isNull()
        later = [] if carry else [F.when(~single & ~ended, F.expr(f"substring(rest, {width + 1})")).alias("rest")]
        passed = met.select(
            *own,
            *later,
            F.when(single, F.col("doc_id")).when(ended, F.col("top")).alias("keep_id"),
            F.when(single, F.lit(1).cast("long")).when(ended, F.col("n")).alias("group_size"),
            F.col("next").alias("gid"),
            F.monotonically_increasing_id().alias("place"),
        )
        passed = materialize(passed, "radix-rows")
        done.append(passed.where("group_size is not null").select(*own, "keep_id", "group_size", F.lit(len(done)).alias("pass"), "gid", "place"))
        rows = passed.where("group_size is null").select(*own, *rest, "gid")
        if rows.isEmpty():
            break
        offset, width = offset + width, min(width * growth, WIDEST)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def exact_dedup(docs: DataFrame, carry: bool = False, **digits: int) -> DataFrame:
    """groups_of with kept: true for one row of each group, one with the largest doc_id."""
    found = groups_of(docs, carry, **digits)
    rivals = found.where("group_size > 1 and doc_id <=> keep_id")
    others = found.where("group_size = 1 or not (doc_id <=> keep_id)").withColumn("kept", F.col("group_size") == 1)
    first = rivals.groupBy("pass", "gid").agg(F.min("place").alias("place")).select("pass", "place", F.lit(True).alias("kept"))
    # rows meet by their place, not by their group, so that the rivals of a huge group are dealt evenly
    decided = rivals.join(first, ["pass", "place"], "left").withColumn("kept", F.col("kept").isNotNull())
    return others.unionByName(decided).drop("pass", "gid", "place")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, one of each group of equal texts."""
    return exact_dedup(docs, carry=True).where("kept").select("row.*")


def op5_radix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts over all documents."""
    return exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256
FROM t
"""
