from pathlib import Path

import pytest

from brindle import slt
from brindle.engine import Engine

FILE = Path(__file__).parent / "slt" / "basics.slt"


def test_file(spark, tmp_path):
    failures = slt.run_file(Engine(spark, f"file://{tmp_path}"), str(FILE))
    # the last query's digest is wrong on purpose
    assert len(failures) == 1 and "2 values hashing to" in failures[0], failures


@pytest.mark.parametrize("name", ["aggregates", "grouping", "casts", "ctes", "changes", "times", "subqueries"])
def test_scenarios(spark, tmp_path, name):
    assert slt.run_file(Engine(spark, f"file://{tmp_path}"), str(FILE.parent / f"{name}.slt")) == []


def test_an_error_must_be_the_sqls(spark, tmp_path):
    """A statement that the engine doesn't know isn't the error that was wanted."""
    failures = slt.run(Engine(spark, f"file://{tmp_path}"), "statement error\ncreate trigger x\n\nstatement error\nselect 1 / 0\n")
    assert len(failures) == 1 and failures[0].startswith("1: not supported")


def test_records():
    found = slt.parse("statement error\nselect\n\n# no\nquery IT rowsort\nselect 1,\n2\n----\n1\ta\n\nhalt\n\nquery I\nselect 3\n")
    assert [(r.kind, r.arguments, r.sql, r.expected) for r in found] == [("statement", ["error"], "select", []), ("query", ["IT", "rowsort"], "select 1,\n2", ["1\ta"])]
    assert [slt.shown(v, t) for v, t in ((None, "I"), ("", "T"), (2, "R"), (True, "T"))] == ["NULL", "(empty)", "2.000", "true"]
