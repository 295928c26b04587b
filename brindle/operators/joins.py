"""Every kind of join.  ``on`` is SQL over both sides' columns, or a list of shared column names.

The physical strategy is left to Catalyst and AQE; no side is forced to be broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = {"inner": "inner", "left": "left", "right": "right", "outer": "full", "full": "full", "semi": "left_semi", "anti": "left_anti"}


def join(left: DataFrame, right: DataFrame, on: str | list[str] | Column | None, kind: str = "inner") -> DataFrame:
    """Rows of both sides that match; ``left``, ``right`` and ``outer`` keep unmatched rows of that side or both.

    ``semi`` and ``anti`` keep rows of ``left`` with and without a match.  NULL
    keys match nothing, so ``anti`` keeps them.
    """
    if on is None:
        return left.crossJoin(right)
    return left.join(right, F.expr(on) if isinstance(on, str) else on, KINDS[kind])


def mark(left: DataFrame, right: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``left`` with a BOOLEAN column, never NULL: whether ``right`` has a row with equal ``keys``."""
    taken = {c.lower() for c in left.columns + right.columns}
    made = [next(n for i in range(len(taken) + 1) if (n := f"mark_{at}_{i}") not in taken) for at in range(len(keys))]
    there = right  # an existence join: the right side isn't made distinct first
    for k, n in zip(keys, made, strict=True):
        there = there.where(F.col(k) == F.col(n).outer())
    return left.withColumns({n: F.col(k) for k, n in zip(keys, made, strict=True)}).withColumn(name, there.exists()).drop(*made)


def single(left: DataFrame, right: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """``left`` with the ``value`` of the one row of ``right`` with equal ``keys``, or NULL; several rows are an error."""
    text = "Scalar subquery produced more than one element"
    one = right.groupBy(*keys).agg(F.when(F.count("*") > 1, F.raise_error(F.lit(text))).otherwise(F.any_value(value)).alias(name))
    return left.join(one, keys, "left")


def null_safe(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], kind: str = "inner") -> DataFrame:
    """A join on equality that holds for two NULLs."""
    on = F.lit(True)
    for a, b in pairs:
        on = on & left[a].eqNullSafe(right[b])
    return left.join(right, on, KINDS[kind])
