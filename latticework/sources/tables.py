"""Reading and writing tables. Schemas are given or in the file, never inferred from the data; all paths go through Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

FORMATS = ("parquet", "orc", "json", "csv", "text")


def read(spark: SparkSession, path: str, format: str = "parquet", schema: str | T.StructType | None = None, **options: str) -> DataFrame:
    """A table; formats without a schema of their own need one."""
    if format not in FORMATS:
        raise ValueError(f"unknown format {format!r}: one of {FORMATS}")
    if format in ("json", "csv") and schema is None:
        raise ValueError(f"{format} needs a schema")
    reader = spark.read.format(format).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def read_folder(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """The Parquet tables ``names`` of a folder, also as temporary views."""
    out = {}
    for name in names:
        out[name] = spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
        out[name].createOrReplaceTempView(name)
    return out


def write(df: DataFrame, path: str, format: str = "parquet", partition_by: list[str] | None = None, mode: str = "errorifexists", **options: str) -> None:
    writer = df.write.format(format).mode(mode).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def write_bucketed(df: DataFrame, table: str, keys: list[str], buckets: int, mode: str = "errorifexists") -> None:
    """A table in buckets of ``keys``: later joins and groupings on them don't shuffle it."""
    df.write.bucketBy(buckets, *keys).sortBy(*keys).mode(mode).saveAsTable(table)
