"""Projection, filter, grouping, order and union."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.plans.dialect import to_spark

#: name -> an aggregate of one argument in the dialect; all but COUNT are NULL over no values, SUM and AVG refuse strings.
AGGREGATES = {
    **{name: name + "({})" for name in "any_value count logical_and logical_or max min sum avg".split()},
    **{f"{name}_distinct": name + "(distinct {})" for name in ("count", "sum", "avg")},
}


def expression(text: str) -> Column:
    """A Column of an expression in the dialect."""
    return F.expr(to_spark(text))


def project(df: DataFrame, keep: bool = False, **columns: str) -> DataFrame:
    """New columns by expression; ``keep`` leaves the others in front."""
    made = [expression(text).alias(name) for name, text in columns.items()]
    return df.select(*(["*"] if keep else []), *made)


def where(df: DataFrame, *predicates: str) -> DataFrame:
    """Rows for which every predicate is true; NULL rejects."""
    for p in predicates:
        df = df.where(expression(p))
    return df


def aggregate(df: DataFrame, by: list[str] | None = None, **columns: str | tuple[str, str]) -> DataFrame:
    """Groups by columns (NULLs are a group) with aggregates given as ``(function, expression)``.

    Without ``by`` there is one row, also over no input.  ``("count", "*")`` counts rows.
    """
    made = [expression(AGGREGATES[f].format(text)).alias(name) for name, (f, text) in columns.items()]
    if not made:
        return df.select(*(by or [])).distinct()
    return df.groupBy(*by).agg(*made) if by else df.agg(*made)


def order(df: DataFrame, *keys: str) -> DataFrame:
    """By columns, ``-name`` descending; NULL is lowest."""
    return df.orderBy(*[F.col(k[1:]).desc_nulls_last() if k.startswith("-") else F.col(k).asc_nulls_first() for k in keys])


def limit(df: DataFrame, n: int, offset: int = 0) -> DataFrame:
    return df.offset(offset).limit(n) if offset else df.limit(n)


def union_all(*parts: DataFrame) -> DataFrame:
    """Rows of all parts, columns by position, names of the first."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out
