"""Runs SQL logic tests: text files of statements and queries with their expected results.

Records are separated by blank lines::

    statement ok|error
    <sql>

    query <types> [nosort|rowsort|valuesort]
    <sql>
    ----
    <values, a line a row (tab between columns) or a line a value>

Types are I (integer), R (three decimals) and T (text).  NULL prints as ``NULL``
and an empty text as ``(empty)``.  A result of the form ``N values hashing to H``
is compared by the MD5 of its lines.  ``halt`` ends a file; ``#`` is a comment.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from pathlib import Path

from brindle.engine import Engine


@dataclass
class Record:
    line: int
    kind: str
    arguments: list[str]
    sql: str
    expected: list[str] = field(default_factory=list)


def parse(text: str) -> list[Record]:
    records: list[Record] = []
    lines = text.splitlines() + [""]
    at = 0
    while at < len(lines):
        head = lines[at].strip()
        at += 1
        if not head or head.startswith("#"):
            continue
        if head == "halt":
            break
        kind, *arguments = head.split()
        if kind not in ("statement", "query"):
            continue
        start, sql, expected = at, [], []
        while at < len(lines) and lines[at].strip() not in ("", "----"):
            sql.append(lines[at])
            at += 1
        if at < len(lines) and lines[at].strip() == "----":
            at += 1
            while at < len(lines) and lines[at] != "":
                expected.append(lines[at])
                at += 1
        records.append(Record(start, kind, arguments, "\n".join(sql), expected))
    return records


def shown(value: object, kind: str) -> str:
    if value is None:
        return "NULL"
    if kind == "I":
        return str(int(value))
    if kind == "R":
        return f"{float(value):.3f}"
    text = str(value).lower() if isinstance(value, bool) else str(value)
    return text or "(empty)"


def _check(record: Record, rows: list[tuple]) -> str | None:
    types, sort = record.arguments[0], (record.arguments[1:] or ["nosort"])[0]
    if rows and len(rows[0]) != len(types):
        return f"{len(rows[0])} columns, not {len(types)}"
    got = [[shown(v, t) for v, t in zip(r, types, strict=True)] for r in rows]
    if sort == "rowsort":
        got.sort()
    values = [v for r in got for v in r]
    if len(record.expected) == 1 and " values hashing to " in record.expected[0]:
        number, digest = record.expected[0].split(" values hashing to ")
        found = hashlib.md5("".join(f"{v}\n" for v in values).encode()).hexdigest()
        return None if (int(number), digest.strip()) == (len(values), found) else f"{len(values)} values hashing to {found}"
    whole = len(record.expected) == len(got) and len(types) > 1
    want = [v for line in record.expected for v in (line.split("\t") if whole else [line])]
    if sort == "rowsort" and whole:
        want = [v for r in sorted(line.split("\t") for line in record.expected) for v in r]
    if sort == "valuesort":
        values, want = sorted(values), sorted(want)
    return None if values == want else f"got {values}, not {want}"


def run(engine: Engine, text: str) -> list[str]:
    """Failures, as ``line: what``."""
    failures = []
    for record in parse(text):
        wrong = record.arguments[:1] == ["error"]
        try:
            result = engine.sql(record.sql)
            rows = [tuple(r) for r in result.collect()] if result is not None else []
        except Exception as e:
            if not wrong or str(e).startswith("not supported"):  # a gap of ours isn't the error that is wanted
                failures.append(f"{record.line}: {str(e).splitlines()[0]}")
            continue
        if wrong:
            failures.append(f"{record.line}: no error")
        elif record.kind == "query" and (problem := _check(record, rows)):
            failures.append(f"{record.line}: {problem}")
    return failures


def run_file(engine: Engine, path: str) -> list[str]:
    return run(engine, Path(path).read_text())
