"""Arithmetic.  Results of rounding are DOUBLE; logarithms of numbers <= 0 are -Infinity or NaN."""

from __future__ import annotations


def _log(name: str):
    return lambda x: f"(case when ({x}) = 0 then cast('-Infinity' as double) when ({x}) < 0 then cast('NaN' as double) else {name}({x}) end)"


def _whole(name: str, x: str) -> str:
    # beyond 2**53 every double is whole, and ceil and floor would leave BIGINT's range
    return f"(case when abs({x}) >= 9007199254740992D or isnan({x}) then cast({x} as double) else cast({name}(cast({x} as double)) as double) end)"


def _trunc(x: str, n: str | None = None) -> str:
    if n is not None:
        return f"({_trunc(f'(({x}) * pow(10D, {n}))')} / pow(10D, {n}))"
    d = f"cast({x} as double)"
    return f"nanvl({d} - {d} % 1D, {d})"  # the remainder is exact; that of an infinity is NaN


def _round(x: str, n: str | None = None) -> str:
    if n is None:
        return f"round(cast({x} as double))"
    if n.strip().lstrip("-").isdigit():
        return f"round(cast({x} as double), {n})"
    return f"(round(cast({x} as double) * pow(10D, {n})) / pow(10D, {n}))"


def _sign(x: str) -> str:
    """BIGINT for BIGINT, DOUBLE for DOUBLE; 0 has the sign 0."""
    return f"(({x}) - ({x}) + (case when ({x}) > 0 then 1 when ({x}) < 0 then -1 when ({x}) = 0 then 0 end))"


TEMPLATES = {
    **{name: (lambda n: lambda x: f"{n}({x})")(name) for name in "abs acos acosh asin asinh atan atanh cos cosh exp sin sinh sqrt tan tanh".split()},
    "atan2": lambda y, x: f"atan2({y}, {x})",
    "pow": lambda x, y: f"pow({x}, {y})",
    "power": lambda x, y: f"pow({x}, {y})",
    "ceil": lambda x: _whole("ceil", x),
    "ceiling": lambda x: _whole("ceil", x),
    "floor": lambda x: _whole("floor", x),
    "ln": _log("ln"),
    "log10": _log("log10"),
    "log": lambda x, base=None: _log("ln")(x) if base is None else f"({_log('ln')(x)} / {_log('ln')(base)})",
    "round": _round,
    "trunc": _trunc,
    "sign": _sign,
    "mod": lambda i, j: f"(({i}) % ({j}))",
    "div": lambda i, j: f"(({i}) div ({j}))",
    "divide": lambda x, y: f"(case when ({x}) = 0 and ({y}) = 0 then cast('NaN' as double) else ({x}) / ({y}) end)",
}
