"""Dates and timestamps, in UTC, with bare date parts such as ``MONTH`` or ``WEEK(MONDAY)``."""

from __future__ import annotations

import re

_DAYS = {"SUNDAY": "SUN", "MONDAY": "MON", "TUESDAY": "TUE", "WEDNESDAY": "WED", "THURSDAY": "THU", "FRIDAY": "FRI", "SATURDAY": "SAT"}
_MICROS = {"MICROSECOND": 1, "MILLISECOND": 10**3, "SECOND": 10**6, "MINUTE": 60 * 10**6, "HOUR": 3600 * 10**6, "DAY": 86400 * 10**6}
_STRFTIME = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "j": "DDD", "y": "yy", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "I": "hh", "p": "a"}
#: DAY and coarser.
DATE_PARTS = {"DAY", "WEEK", "ISOWEEK", "MONTH", "QUARTER", "YEAR", "ISOYEAR"}


def part_of(text: str) -> tuple[str, str]:
    """A part's name and, of a week, the day it begins with."""
    found = re.fullmatch(r"\s*(\w+)\s*(?:\(\s*(\w+)\s*\))?\s*", text)
    if not found:
        raise ValueError(f"not a date part: {text}")
    name, day = found[1].upper(), (found[2] or "SUNDAY").upper()
    if name == "NANOSECOND" or (found[2] and name != "WEEK") or day not in _DAYS:
        raise ValueError(f"date part {text.strip()} is not supported")
    return ("WEEK", "MON") if name == "ISOWEEK" else (name, _DAYS[day])


def _week(d: str, day: str) -> str:
    return f"next_day(date_sub({d}, 7), '{day}')"


def date_trunc(d: str, part: str) -> str:
    name, day = part_of(part)
    iso = f"make_date(extract(yearofweek from {d}), 1, 4)"
    forms = {"DAY": d, "WEEK": _week(d, day), "MONTH": f"trunc({d}, 'MM')", "QUARTER": f"trunc({d}, 'QUARTER')", "YEAR": f"trunc({d}, 'YEAR')", "ISOYEAR": _week(iso, "MON")}
    return f"cast({forms[name]} as date)"


def timestamp_trunc(ts: str, part: str) -> str:
    name, _ = part_of(part)
    if name in DATE_PARTS:
        return f"cast({date_trunc(f'cast({ts} as date)', part)} as timestamp)"
    if name not in _MICROS:
        raise ValueError(f"timestamp_trunc has no part {name}")
    return f"cast(date_trunc('{name}', {ts}) as timestamp)"


def extract(part: str, x: str) -> str:
    """``x`` is a date or a timestamp; the result is BIGINT."""
    name, day = part_of(part)
    if name == "WEEK" and part.strip().upper() != "ISOWEEK":
        d = f"cast({x} as date)"
        first = f"next_day(date_sub(make_date(year({d}), 1, 1), 1), '{day}')"
        return f"cast(case when {d} < {first} then 0 else datediff({d}, {first}) div 7 + 1 end as bigint)"
    if name == "DATE":
        return f"cast({x} as date)"
    micros = f"unix_micros(cast({x} as timestamp))"
    forms = {
        "WEEK": f"extract(week from {x})",
        "ISOYEAR": f"extract(yearofweek from {x})",
        "DAYOFWEEK": f"dayofweek({x})",
        "DAYOFYEAR": f"dayofyear({x})",
        "SECOND": f"floor(extract(second from {x}))",
        "MILLISECOND": f"pmod({micros}, 1000000) div 1000",
        "MICROSECOND": f"pmod({micros}, 1000000)",
    }
    if name not in forms and name not in DATE_PARTS | {"HOUR", "MINUTE"}:
        raise ValueError(f"extract has no part {name}")
    return f"cast({forms.get(name, f'extract({name} from {x})')} as bigint)"


def _interval(text: str) -> tuple[str, str]:
    """``interval n part`` as number and part."""
    found = re.fullmatch(r"\s*interval\s+(.+?)\s+(\w+)\s*", text, re.S | re.I)
    if not found:
        raise ValueError(f"not an interval: {text}")
    return found[1], found[2]


def _in_range(d: str) -> str:
    return f"(case when ({d}) < date'0001-01-01' or ({d}) > date'9999-12-31' then raise_error('date out of range') else {d} end)"


def date_add(d: str, interval: str, part: str | None = None, sign: str = "") -> str:
    n, part = (interval, part) if part else _interval(interval)
    name, _ = part_of(part)
    n = f"cast({sign}({n}) as int)"
    forms = {"DAY": f"date_add({d}, {n})", "WEEK": f"date_add({d}, 7 * {n})", "MONTH": f"add_months({d}, {n})", "QUARTER": f"add_months({d}, 3 * {n})", "YEAR": f"add_months({d}, 12 * {n})"}
    if name not in forms or part.strip().upper() == "ISOWEEK":
        raise ValueError(f"date_add has no part {part}")
    return _in_range(forms[name])


def date_diff(a: str, b: str, part: str) -> str:
    """How many boundaries of ``part`` lie between ``b`` and ``a``."""
    name, day = part_of(part)
    years = f"(year({a}) - year({b}))"
    forms = {
        "DAY": f"datediff({a}, {b})",
        "WEEK": f"datediff({_week(a, day)}, {_week(b, day)}) div 7",
        "MONTH": f"{years} * 12 + month({a}) - month({b})",
        "QUARTER": f"{years} * 4 + quarter({a}) - quarter({b})",
        "YEAR": years,
        "ISOYEAR": f"extract(yearofweek from {a}) - extract(yearofweek from {b})",
    }
    if name not in forms:
        raise ValueError(f"date_diff has no part {name}")
    return f"cast({forms[name]} as bigint)"


def timestamp_add(ts: str, interval: str, part: str | None = None, sign: str = "") -> str:
    n, part = (interval, part) if part else _interval(interval)
    return f"timestamp_micros(unix_micros(cast({ts} as timestamp)) + {sign}(cast({n} as bigint)) * {_MICROS[part_of(part)[0]]})"


def timestamp_diff(a: str, b: str, part: str) -> str:
    """Whole units of a time; boundaries of DAY and coarser."""
    name, _ = part_of(part)
    if name in DATE_PARTS:
        return date_diff(f"cast({a} as date)", f"cast({b} as date)", part)
    return f"((unix_micros(cast({a} as timestamp)) - unix_micros(cast({b} as timestamp))) div {_MICROS[name]})"


def java_pattern(literal: str) -> str:
    """A strftime format, given as a string literal, as Spark's datetime pattern literal."""
    found = re.fullmatch(r"\s*'(.*)'\s*", literal, re.S)
    if not found:
        raise ValueError("the format must be a literal")
    out = []
    for code, text in re.findall(r"%(.)|([^%]+)", found[1], re.S):
        if code and code != "%" and code not in _STRFTIME:
            raise ValueError(f"format directive %{code} is not supported")
        out.append(_STRFTIME.get(code) or re.sub(r"[A-Za-z]+", lambda m: f"\\'{m[0]}\\'", text or "%"))
    return "'" + "".join(out) + "'"


def _string(x: str) -> str:
    """Dates as yyyy-MM-dd; timestamps as RFC 3339, with a fraction of 3 or 6 digits if there is one."""
    micros = f"pmod(unix_micros(cast({x} as timestamp)), 1000000)"
    fraction = f"(case when {micros} = 0 then '' when {micros} % 1000 = 0 then date_format({x}, '.SSS') else date_format({x}, '.SSSSSS') end)"
    return f"(case when typeof({x}) = 'date' then date_format({x}, 'yyyy-MM-dd') else concat(date_format({x}, 'yyyy-MM-dd\\'T\\'HH:mm:ss'), {fraction}, '+00:00') end)"


TEMPLATES = {
    "date": lambda *a: f"make_date(cast({a[0]} as int), cast({a[1]} as int), cast({a[2]} as int))" if len(a) == 3 else f"cast({a[0]} as date)",
    "timestamp": lambda x: f"cast({x} as timestamp)",
    "string": _string,
    "date_from_unix_date": lambda n: f"date_from_unix_date(cast({n} as int))",
    "unix_date": lambda d: f"cast(unix_date({d}) as bigint)",
    "timestamp_from_unix_micros": lambda n: f"timestamp_micros({n})",
    "timestamp_micros": lambda n: f"timestamp_micros({n})",
    "unix_micros": lambda ts: f"unix_micros(cast({ts} as timestamp))",
    "unix_millis": lambda ts: f"unix_millis(cast({ts} as timestamp))",
    "date_trunc": date_trunc,
    "timestamp_trunc": timestamp_trunc,
    "extract": extract,
    "date_add": date_add,
    "date_sub": lambda d, interval, part=None: date_add(d, interval, part, "-"),
    "date_diff": date_diff,
    "timestamp_add": timestamp_add,
    "timestamp_sub": lambda ts, interval, part=None: timestamp_add(ts, interval, part, "-"),
    "timestamp_diff": timestamp_diff,
    "format_date": lambda f, d: f"date_format({d}, {java_pattern(f)})",
    "format_timestamp": lambda f, ts: f"date_format({ts}, {java_pattern(f)})",
    "parse_date": lambda f, s: f"to_date({s}, {java_pattern(f)})",
    "parse_timestamp": lambda f, s: f"to_timestamp({s}, {java_pattern(f)})",
}
