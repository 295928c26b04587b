"""Scalar functions as SQL templates: all of them run JVM-side, inside codegen.

``sql(name, *args)`` gives the Spark SQL text of a call whose arguments are SQL
texts; ``call(name, *args)`` gives the Column.  NULL arguments give NULL unless a
function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.functions import conditional, datetimes, maths, strings

TEMPLATES = conditional.TEMPLATES | strings.TEMPLATES | maths.TEMPLATES | datetimes.TEMPLATES


def sql(name: str, *args: str) -> str:
    """Spark SQL for the call of ``name``; raises KeyError for names that aren't ours."""
    return TEMPLATES[name.lower()](*args)


def call(name: str, *args: str) -> Column:
    return F.expr(sql(name, *args))
