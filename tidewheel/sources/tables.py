"""Tables with a fixed schema, append sinks, versioned writes and JDBC reads."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def checked(df: DataFrame, schema: StructType | str, keys: list[str] | None = None) -> DataFrame:
    """df with the columns of a schema in its order; ValueError if a name or type differs, or a key repeats."""
    want = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    have = {f.name: f.dataType for f in df.schema}
    wrong = [f.name for f in want if have.get(f.name) != f.dataType]
    if wrong:
        raise ValueError(f"columns missing or of another type: {', '.join(wrong)}")
    if keys and not df.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError(f"{', '.join(keys)} is no key")
    return df.select(*want.names)


def append(rows: DataFrame, path: str, schema: StructType | str) -> None:
    """Append-only sink, such as audit and job history."""
    checked(rows, schema).write.mode("append").parquet(path)


def write_version(df: DataFrame, path: str) -> str:
    """Writes a new version of a table beside the old ones, then names it current; readers see one or the other."""
    version = uuid.uuid4().hex
    df.write.parquet(f"{path}/data-{version}")
    spark = df.sparkSession
    spark.range(1).select(F.lit(json.dumps({"version": version})).alias("value"), F.current_timestamp().alias("at")).write.mode("append").parquet(f"{path}/versions")
    return version


def read_version(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    """The current version of a table, or a named one."""
    if version is None:
        last = spark.read.schema("value string, at timestamp").parquet(f"{path}/versions").agg(F.max_by("value", "at")).first()[0]
        version = json.loads(last)["version"]
    return spark.read.parquet(f"{path}/data-{version}")


def read_jdbc(spark: SparkSession, url: str, relation: str, key: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 8, **options: str) -> DataFrame:
    """A relation of a database; with a numeric key and its bounds, read by several tasks. The driver jar is the session's."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=relation, **options)
    if key and bounds:
        reader = reader.options(partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions)
    return reader.load()
