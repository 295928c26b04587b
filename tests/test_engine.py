"""Scripts: changes, snapshots, catalogs, parameters."""

import pytest

from brindle import stats
from brindle.engine import Engine
from brindle.operators import joins
from brindle.operators.relational import aggregate, order, union_all


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_insert_update_delete(engine):
    engine.sql("create table t(a integer, b varchar); insert into t values (1, 'x'), (2, 'y'), (null, null); insert into t(b) values ('z')")
    assert rows(engine.sql("select * from t")) == rows_of((1, "x"), (2, "y"), (None, None), (None, "z"))
    engine.sql("update t set b = concat(b, '!'), a = a * 10 where a = 2")
    engine.sql("delete from t where a is null and b is null")
    assert rows(engine.sql("select * from t")) == rows_of((1, "x"), (20, "y!"), (None, "z"))
    engine.sql("delete from t where a > 1000")
    engine.sql("update t set a = (select max(a) from t) where a is null")
    assert rows(engine.sql("select a from t where b = 'z'")) == [(20,)]
    engine.sql("insert into t select a + 1, b from t")
    assert engine.sql("select count(*) from t").first()[0] == 6


def rows_of(*values):
    return sorted(values, key=str)


def test_update_from(engine):
    engine.sql("create table t(k integer, v integer); create table u(k integer, w integer); insert into t values (1, 0), (2, 0); insert into u values (1, 5), (3, 7)")
    engine.sql("update t set v = w from u where t.k = u.k")
    assert rows(engine.sql("select * from t")) == [(1, 5), (2, 0)]
    engine.sql("insert into u values (1, 6)")
    with pytest.raises(ValueError):
        engine.sql("update t set v = w from u where t.k = u.k")


def test_snapshots(engine):
    engine.sql("create table t(a integer); insert into t values (1), (2)")
    version = engine.snapshot("t")
    engine.sql("delete from t where a = 1; insert into t values (3)")
    assert rows(engine.table("t", version)) == [(1,), (2,)]
    assert rows(engine.sql("select a from t", at={"t": version})) == [(1,), (2,)]
    assert rows(engine.sql("select a from t")) == [(2,), (3,)]


def test_a_version_is_written_once(engine):
    engine.sql("create table t(a integer)")
    data = engine.catalog.table(["t"]).data
    data._commit(1, [])
    with pytest.raises(Exception):
        data._commit(1, [])


def test_nested_databases(engine):
    engine.sql("create database a; create database a.b; create table a.b.t(i integer); create table t(i integer); insert into a.b.t values (1), (2); insert into t values (9)")
    assert rows(engine.sql("select t.i from a.b.t where t.i > 1")) == [(2,)]
    assert rows(engine.sql("select x.i, t.i from a.b.t as x, t")) == [(1, 9), (2, 9)]
    engine.sql("update a.b.t set i = i + 1 where i = 2; delete from a.b.t where i = 1; create index ix on a.b.t(i)")
    assert rows(engine.sql("select i from a.b.t")) == [(3,)]
    assert rows(engine.sql("select index_name from metadata.index")) == [("ix",)]
    assert rows(engine.sql("select catalog_name from metadata.catalog")) == [("a",), ("b",), ("root",)]
    engine.sql("drop table a.b.t")
    with pytest.raises(Exception):
        engine.sql("select i from a.b.t")


@pytest.mark.parametrize("text", ["create table t(i integer)", "create database d", "create table x(i numeric)", "create index i on missing(a)", "create index i on t(missing)", "drop table missing", "delete from t", "insert into t values (1, 2)", "assert 1 = 2", "assert null", "call nothing(1)", "select * from missing"])
def test_refused(engine, text):
    engine.sql("create table t(i integer); create database d; create table if not exists t(i integer)")
    with pytest.raises(Exception):
        engine.sql(text)


@pytest.mark.parametrize("text", ["select sum(s) from t", "select avg(distinct s) from t", "select sum(i > 1) from t", "select sum(d) from t"])
def test_sums_are_of_numbers(engine, text):
    engine.sql("create table t(i integer, s varchar, d date); insert into t values (1, '2', date '2020-01-01')")
    assert rows(engine.sql("select sum(i), avg(distinct i), sum(distinct i + 0.5D) from t")) == [(1, 1.0, 1.5)]
    with pytest.raises(Exception):
        engine.sql(text).collect()


def test_parameters_explain_assert(engine):
    engine.sql("create table t(i integer, s varchar); insert into t values (@a, @b), (2, 'q')", {"a": 1, "b": "it's"})
    assert rows(engine.sql("select s from t where i = @a", {"a": 1})) == [("it's",)]
    assert "Scan" in engine.sql("explain select * from t where i = 1").first()[0]
    engine.sql("assert (select count(*) from t) = 2")
    with pytest.raises(AssertionError, match="wrong"):
        engine.sql("assert false as 'wrong'")
    assert rows(engine.sql("select 1, 'a',")) == [(1, "a")]
    assert engine.analyze("t")["rows"] == 2


def test_joins(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k bigint, x string")
    b = spark.createDataFrame([(1, 10), (1, 11), (None, 12), (4, 13)], "k bigint, y bigint")
    on = "a.k = b.k"
    sides = a.alias("a"), b.alias("b")
    counts = {kind: joins.join(*sides, on, kind).count() for kind in joins.KINDS}
    assert counts == {"inner": 2, "left": 4, "right": 4, "outer": 6, "full": 6, "semi": 1, "anti": 2}
    assert joins.join(a, b, None).count() == 12
    assert rows(joins.mark(a, b, ["k"], "m").select("x", "m")) == [("a", True), ("b", False), ("c", False)]
    assert rows(joins.single(a, b.where("y > 10"), ["k"], "y", "y").select("x", "y")) == [("a", 11), ("b", None), ("c", None)]
    with pytest.raises(Exception, match="more than one element"):
        joins.single(a, b, ["k"], "y", "y").collect()
    assert joins.null_safe(a, b, [("k", "k")]).count() == 3


def test_aggregates_and_order(spark):
    df = spark.createDataFrame([(1, True, 1.0), (1, None, None), (None, False, 3.0), (None, True, 3.0)], "k bigint, p boolean, x double")
    got = aggregate(df, ["k"], n=("count", "*"), c=("count", "x"), a=("logical_and", "p"), o=("logical_or", "p"), s=("sum", "x"), d=("count_distinct", "x"), v=("avg_distinct", "x"))
    assert rows(got) == rows_of((1, 2, 1, True, True, 1.0, 1, 1.0), (None, 2, 2, False, True, 6.0, 1, 3.0))
    assert rows(aggregate(df.where("false"), n=("count", "*"), s=("sum", "x"))) == [(0, None)]
    assert aggregate(df, ["k"]).count() == 2
    assert [r.x for r in order(df, "-x", "k").select("x").collect()] == [3.0, 3.0, 1.0, None]
    assert union_all(df, df, df).count() == 12


def test_statistics(spark):
    df = spark.range(10_000).selectExpr("id", "id % 100 as g", "if(id % 4 = 0, null, 'x') as s")
    found = stats.summarise(df)
    assert found["rows"] == 10_000 and found["columns"]["s"]["nulls"] == 2500
    assert abs(found["columns"]["g"]["distinct"] - 100) <= 10 and abs(found["columns"]["id"]["distinct"] - 10_000) < 1500
    assert abs(stats.selectivity(found["columns"]["id"], 10_000, 0, 4999) - 0.5) < 0.06
    assert abs(stats.selectivity(found["columns"]["g"], 10_000, 5, 5) - 0.01) < 0.002


def test_transactions(engine):
    engine.sql("create table t(a integer); create table u(a integer); insert into t values (1), (2)")
    with engine.transaction() as first:
        engine.sql("delete from t where a = 1; insert into u select a from t; insert into u values (xid())")
        assert rows(engine.sql("select a from u")) == rows_of((2,), (first,))
        assert rows(engine.table("u", 0)) == []
    assert rows(engine.sql("select a from t")) == [(2,)] and rows(engine.sql("select a from u")) == rows_of((2,), (first,))
    before = engine.snapshot("t")
    with pytest.raises(AssertionError), engine.transaction() as second:
        engine.sql("insert into t values (9); assert (select count(*) from t) = 7")
    assert second == first + 1 and engine.snapshot("t") == before and rows(engine.sql("select a from t")) == [(2,)]
    # a table that another writer has changed meanwhile
    data = engine.catalog.table(["t"]).data
    other = type(data)(engine.spark, data.path, data.columns)
    with pytest.raises(Exception), engine.transaction():
        engine.sql("insert into t values (3)")
        other.insert(engine.spark.sql("select 4"))
    assert rows(engine.sql("select a from t")) == rows_of((2,), (4,))


def test_a_catalog_is_found_again(engine, spark):
    engine.sql("create database a; create table a.t(i integer, s varchar); create index x on a.t(s); insert into a.t values (1, 'b'), (2, 'a')")
    again = Engine(spark, engine.catalog.root_path)
    assert rows(again.sql("select i, s from a.t")) == rows(engine.sql("select i, s from a.t"))
    assert again.catalog.table(["a", "t"]).data.indexed == [["s"]]
    assert [tuple(r) for r in again.sql("select index_name from metadata.index").collect()] == [("x",)]
    again.sql("create table a.u(i integer)")
    assert again.catalog.table(["a", "u"]).id == engine.catalog.table(["a", "t"]).id + 1
    again.sql("drop table a.t")
    assert Engine(spark, engine.catalog.root_path).sql("select count(*) from metadata.index").first()[0] == 0


def test_an_index_orders_segments_and_filters_row_groups(engine):
    engine.sql("create table t(k integer, s varchar); insert into t select id % 7, string(date_from_unix_date(id)) from (select explode(sequence(1, 500)) as id); create index x on t(k, s)")
    engine.sql("insert into t values (3, 'z'), (1, 'y'), (2, 'x')")
    data = engine.catalog.table(["t"]).data
    for segment in data.segments():
        files: dict = {}
        for r in engine.spark.read.parquet(f"{data.path}/segments/{segment}").selectExpr("k", "s", "_metadata.file_path as f").collect():
            files.setdefault(r.f, []).append((r.k, r.s))
        assert all(keys == sorted(keys) for keys in files.values())
    assert engine.sql("select count(*) from t where k = 3 and s = 'z'").first()[0] == 1
    plan = engine.sql("explain select s from t where k = 3").first()[0]
    assert "EqualTo(k,3)" in plan


def test_a_change_is_evaluated_once(engine):
    engine.sql("create table t(a integer, x double); insert into t select explode(sequence(1, 50)), 0.0")
    engine.sql("update t set x = rand() where rand() < 0.5")
    changed = engine.sql("select count(*) from t where x > 0").first()[0]
    assert 0 < changed < 50 and engine.sql("select count(*) from t").first()[0] == 50
    engine.sql("delete from t where rand() < 0.5")
    assert 0 < engine.sql("select count(*) from t").first()[0] < 50
    assert len({engine.snapshot("t")}) == 1
    engine.catalog.table(["t"]).data.compact()
    assert len(engine.catalog.table(["t"]).data.segments()) == 1


def test_names_in_strings_and_comments_stay(engine):
    engine.sql("create database shop; create table shop.item(i integer); insert into shop.item values (1)")
    got = engine.sql("select 'from shop.item where' as v, shop.item.i as i, /* shop.item */ item.i + 1 as j from shop.item where shop.item.i = 1 -- shop.item")
    assert rows(got) == [("from shop.item where", 1, 2)]
    assert rows(engine.sql("select x.i, y.i from shop.item x, shop.item as y")) == [(1, 1)]


def test_aggregates_refuse_strings(spark):
    df = spark.sql("select 'a' as s")
    for f in ("sum", "avg", "sum_distinct"):
        with pytest.raises(Exception):
            aggregate(df, x=(f, "s")).collect()


def test_trace(engine):
    import json

    engine.sql("create table t(a integer); insert into t values (1), (2), (2)")
    events = json.loads(engine.trace("select a, count(*) as n from t where a > @least group by a", {"least": 1}))["traceEvents"]
    assert events[0]["args"]["rows"] == 1
    assert {"analysis", "optimization", "planning"} <= {e["name"] for e in events}
