"""Column statistics in one pass over a table."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUANTILES = [i / 20 for i in range(21)]


def summarise(df: DataFrame, error: float = 0.05) -> dict[str, Any]:
    """Row count, and for each column nulls, distinct values (HyperLogLog++), and quantiles of numbers."""
    wanted = [F.count("*").alias("rows")]
    numbers = {c for c, t in df.dtypes if t in ("bigint", "int", "double", "float")}
    for i, c in enumerate(df.columns):
        column = F.col(f"`{c}`")
        wanted += [F.count(column).alias(f"n{i}"), F.approx_count_distinct(column, error).alias(f"d{i}")]
        if c in numbers:
            wanted.append(F.percentile_approx(column.cast("double"), QUANTILES, 1000).alias(f"q{i}"))
    row = df.agg(*wanted).first()
    return {"rows": row["rows"], "columns": {c: {"nulls": row["rows"] - row[f"n{i}"], "distinct": row[f"d{i}"], "quantiles": row[f"q{i}"] if c in numbers else None} for i, c in enumerate(df.columns)}}


def selectivity(column: dict[str, Any], rows: int, low: float | None = None, high: float | None = None) -> float:
    """The share of rows whose value lies from ``low`` to ``high``, by the quantiles; of one value by the distinct ones."""
    if not rows or column["nulls"] == rows:
        return 0.0
    there = 1 - column["nulls"] / rows
    if low is not None and low == high:
        return there / max(1, column["distinct"])
    points = column["quantiles"] or []
    inside = sum((low is None or x >= low) and (high is None or x <= high) for x in points)
    return there * inside / max(1, len(points))
