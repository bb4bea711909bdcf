"""Corpus pipeline: quality rules, language, exact and near duplicates, packing.

Each stage gets what the stage before it kept, written as Parquet and read again. A quality or
language verdict drops documents; of equal or near-equal documents one stays; the last stage packs
what is left. The two stages that drop duplicates write their result and delete the tables that it came from, so a result
depends on no other call: any number of runs and stages may be read in any order. run() also deletes each stage's output once the
next stage has been written; what its result reads from stays in the scratch folder. Nulls, empty tables and extra columns follow the
operators' docstrings; extra columns are carried to the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewheel.llm import language, packing, quality, radix_dedup, simhash
from tidewheel.llm.common import drop, materialize, recorded, settled, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_known(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return settled(lambda: radix_dedup.keep_one(docs), "exact")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return settled(lambda: simhash.keep_one(docs), "near")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", near_dedup),
    ("best-fit packing", best_fit_packing),
]

#: The trained stages and the packing have no SQL form; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with recorded() as made:
            docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        drop(spark, before + made[:-1])
        before = made[-1:]
    out = STAGES[-1][1](spark, docs, sf_dir)  # packing has written the pieces of all documents
    drop(spark, before)
    return out
