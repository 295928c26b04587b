"""Strings, by character, and regular expressions."""

from __future__ import annotations

import re


def _literal(text: str) -> str | None:
    """The value of a plain string literal, or None."""
    found = re.fullmatch(r"\s*(r?)'((?:[^'\\]|\\.)*)'\s*", text, re.S)
    if not found:
        return None
    return found[2] if found[1] else re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}.get(m[1], m[1]), found[2])


def quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _substr(s: str, pos: str, size: str | None = None) -> str:
    """From ``pos``, 1-based; negative counts from the end, and beyond the beginning is the beginning."""
    at = f"(case when ({pos}) < -length({s}) then 1 when ({pos}) > length({s}) then length({s}) + 1 else cast({pos} as int) end)"
    return f"substr({s}, {at})" if size is None else f"substr({s}, {at}, cast(least({size}, 2147483647) as int))"


def _trim(ends: str):
    """All white space, or the characters of a second argument."""
    patterns = {"b": r"^\\s+|\\s+$", "l": r"^\\s+", "r": r"\\s+$"}
    return lambda s, chars=None: f"{ends if ends != 'b' else 'b'}trim({s}, {chars})" if chars and ends == "b" else f"{ends}trim({chars}, {s})" if chars else f"regexp_replace({s}, '{patterns[ends]}', '')"


def _pad(side: str):
    return lambda s, n, pad="' '": f"{side}pad({s}, cast({n} as int), {pad})"


def _extract(s: str, pattern: str) -> str:
    """The first group, or the whole match without one; NULL if nothing matches."""
    literal = _literal(pattern)
    groups = re.compile(literal).groups if literal is not None else 0
    if groups > 1:
        raise ValueError("regexp_extract takes one group at most")
    return f"(case when regexp_like({s}, {pattern}) then regexp_extract({s}, {pattern}, {groups}) end)"


def _replace(s: str, pattern: str, to: str) -> str:
    r"""All matches; ``\1`` in ``to`` is a group.  An empty match right behind a match doesn't count."""
    literal, found = _literal(to), _literal(pattern)
    if literal is not None:
        to = quoted(re.sub(r"\\(.)|\$", lambda m: "\\$" if m[0] == "$" else f"${m[1]}" if m[1].isdigit() else "\\" + m[1], literal))
    else:
        to = rf"regexp_replace(replace({to}, '$', '\\$'), '\\\\([0-9])', '\\$$1')"
    behind = r"(?:(?!\G)|^)"
    pattern = quoted(f"(?:{found}){behind}") if found is not None else f"concat('(?:', {pattern}, {quoted(')' + behind)})"
    return f"regexp_replace({s}, {pattern}, {to})"


def like_pattern(literal: str) -> str:
    """A LIKE pattern without escapes that aren't needed, which Spark refuses."""
    return re.sub(r"\\(.)", lambda m: m[0] if m[1] in "%_\\" else m[1], literal, flags=re.S)


TEMPLATES = {
    "concat": lambda *a: f"concat({', '.join(a)})",
    "length": lambda s: f"cast(length({s}) as bigint)",
    "char_length": lambda s: f"cast(char_length({s}) as bigint)",
    "character_length": lambda s: f"cast(char_length({s}) as bigint)",
    "byte_length": lambda s: f"cast(octet_length({s}) as bigint)",
    "chr": lambda n: f"decode(unhex(lpad(hex({n}), 8, '0')), 'UTF-32')",
    "lower": lambda s: f"lower({s})",
    "upper": lambda s: f"upper({s})",
    "reverse": lambda s: f"reverse({s})",
    "repeat": lambda s, n: f"repeat({s}, cast({n} as int))",
    "left": lambda s, n: f"(case when ({n}) < 0 then {s} else left({s}, cast({n} as int)) end)",
    "right": lambda s, n: f"right({s}, cast({n} as int))",
    "replace": lambda s, a, b: f"replace({s}, {a}, {b})",
    "strpos": lambda s, t: f"cast(instr({s}, {t}) as bigint)",
    "starts_with": lambda s, t: f"startswith({s}, {t})",
    "ends_with": lambda s, t: f"endswith({s}, {t})",
    "regexp_contains": lambda s, r: f"regexp_like({s}, {r})",
    "regexp_extract": _extract,
    "regexp_replace": _replace,
    "substr": _substr,
    "substring": _substr,
    "trim": _trim("b"),
    "ltrim": _trim("l"),
    "rtrim": _trim("r"),
    "lpad": _pad("l"),
    "rpad": _pad("r"),
}
