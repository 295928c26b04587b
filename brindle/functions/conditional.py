"""NULL handling, predicates and system functions."""

from __future__ import annotations


def _all_or_null(name: str):
    def build(*args: str) -> str:
        if len(args) == 1:
            return args[0]
        return f"(case when {' or '.join(f'({a}) is null' for a in args)} then null else {name}({', '.join(args)}) end)"

    return build


def _of_numbers(name: str):
    """An aggregate that refuses strings, which Spark would cast; the test of the type is folded away."""

    def build(x: str) -> str:
        distinct, x = ("distinct ", x[9:]) if x.lower().startswith("distinct ") else ("", x)
        return f"{name}({distinct}if(typeof({x}) = 'string', raise_error('{name} of a STRING'), {x}))"

    return build


TEMPLATES = {
    "sum": _of_numbers("sum"),
    "avg": _of_numbers("avg"),
    "is_nan": lambda x: f"(case when ({x}) is null then null else isnan({x}) end)",
    "is_inf": lambda x: f"(abs({x}) = cast('Infinity' as double))",
    "coalesce": lambda *a: f"coalesce({', '.join(a)})",
    "ifnull": lambda a, b: f"ifnull({a}, {b})",
    "nullif": lambda a, b: f"nullif({a}, {b})",
    "if": lambda c, a, b: f"if({c}, {a}, {b})",
    "greatest": _all_or_null("greatest"),
    "least": _all_or_null("least"),
    "error": lambda message: f"raise_error({message})",
    "current_date": lambda: "current_date()",
    "current_timestamp": lambda: "current_timestamp()",
    "hash": lambda *a: f"xxhash64({', '.join(a)})",
    "logical_and": lambda x: f"bool_and({x})",
    "logical_or": lambda x: f"bool_or({x})",
}
