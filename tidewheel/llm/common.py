"""What the corpus operators share: scratch tables, Arrow chunks, vocabularies.

Scratch tables go to the folder in ``spark.checkpoint.dir``, which a cluster's
executors share, so that a lost executor costs only the tasks it ran.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.types import StructType

#: Rows of an Arrow batch; together with CHUNK_CHARS it bounds a Python worker's memory.
BATCH_ROWS = 1000
CHUNK_CHARS = 800_000
#: Rows of a table of known size that may be broadcast.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see; on a local master without one, a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidewheel-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for an intermediate table; noted if a ``recorded`` block is open."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    return path


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The scratch folders that are made inside the block, those of blocks inside it included."""
    made: list[str] = []
    token = _made.set(made)
    try:
        yield made
    finally:
        _made.reset(token)
        if (outer := _made.get()) is not None:
            outer.extend(made)


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Deletes scratch folders, in whatever store they are."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(conf).delete(folder, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to a scratch table and reads it again: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """Writes what ``make`` returns and deletes the scratch tables that it came from: no others, so that results of other calls stay."""
    with recorded() as made:
        out = materialize(make(), name)
    drop(out.sparkSession, made[:-1])
    return out


def small_table(spark: SparkSession, rows: list[dict], ddl: str) -> DataFrame:
    """A DataFrame of a bounded number of driver rows, as a JVM-side literal."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{ddl}>>")).alias("r")).select("r.*")


def fits(df: DataFrame, rows: int) -> DataFrame:
    """df, broadcast if its known number of rows allows; joined by Spark's own choice otherwise."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def buckets_of(n: Column) -> Column:
    """How many parts to number n rows in: some for a few rows already, and 65536 rows a part at any size."""
    return F.greatest(F.ceil(n / 65536), F.least(F.lit(64), F.ceil(n / 64))).cast("int")


def numbered(rows: DataFrame, key: str, counts: DataFrame, keys: int, total: int) -> DataFrame:
    """Adds idx, a gapless number from 0 among the rows of each key.

    rows is a written table with ``place``, a number of its own for each row; counts has key and n, with ``keys`` rows, for ``total``
    rows in all. A key's rows are dealt over parts by their place, so that neither a hot key nor equal rows meet in one task.
    """
    sized = counts.select(key, buckets_of(F.col("n")).alias("_of"))
    dealt = rows.join(fits(sized, keys), key).withColumn("_part", F.pmod(F.xxhash64("place"), F.col("_of")).cast("int")).drop("_of")
    sums = dealt.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_n"))
    first = sums.select(key, "_part", (F.sum("_n").over(W.partitionBy(key).orderBy("_part")) - F.col("_n")).alias("_before"))
    mine = F.row_number().over(W.partitionBy(key, "_part").orderBy("place"))
    met = dealt.withColumn("_mine", mine).join(fits(first, 64 * keys + total // 65536), [key, "_part"])
    return met.withColumn("idx", F.col("_before") + F.col("_mine") - 1).drop("_part", "_before", "_mine")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_row(docs: DataFrame):
    """All columns of a row as one, ``row``, so that an operator's own names cannot clash with them."""
    return F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")


def with_columns(docs: DataFrame, keep: list[str], more: str) -> StructType:
    """The schema of some columns of docs and of further ones."""
    return StructType([docs.schema[c] for c in keep] + StructType.fromDDL(more).fields)


def small_batches(spark: SparkSession) -> None:
    """Bounds the rows of an Arrow batch, for very long texts."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) not in range(1, BATCH_ROWS + 1):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow with batches small enough for very long texts."""
    small_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


def chunks(batch: pa.RecordBatch, column: str = "text", most: int = CHUNK_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of a batch with about ``most`` characters of text each; null texts become empty."""
    texts = [t or "" for t in batch.column(column).to_pylist()]
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most or i == len(texts) - 1:
            yield batch.slice(start, i + 1 - start), texts[start : i + 1]
            start, size = i + 1, 0


def out_batch(columns: dict, types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v, types.get(k)) for k, v in columns.items()], names=list(columns))
