"""Files and literal rows as DataFrames."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession

from brindle import types


def read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A table by the kind of its file name: parquet, csv (with header) or json."""
    kind = PurePosixPath(path.rstrip("/")).suffix.lstrip(".") or "parquet"
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.option("header", True).csv(path) if kind == "csv" else getattr(reader, kind)(path)


def tables(spark: SparkSession, folder: str, names: list[str]) -> None:
    """Temporary views of a folder's parquet tables."""
    for name in names:
        spark.read.parquet(f"{folder}/{name}.parquet").createOrReplaceTempView(name)


def values(spark: SparkSession, columns: dict[str, str], rows: list[tuple]) -> DataFrame:
    """Literal rows; ``columns`` maps names to types."""
    return spark.createDataFrame(rows, ", ".join(f"`{c}` {types.spark_type(t)}" for c, t in columns.items()))
