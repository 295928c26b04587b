"""The driver's queries over the relational tables, each with its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle import stats
from brindle.engine import Engine
from brindle.operators import joins
from brindle.operators.relational import aggregate, limit, order, project, union_all, where
from brindle.plans import unnest
from brindle.plans.dialect import to_spark
from brindle.sources.files import values

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _text(name: str, text: str, oracle: str | None = None) -> None:
    """A query in the dialect; DuckDB runs the same text unless it needs its own."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        for table in TABLES:
            if table in text:
                _table(spark, sf, table).createOrReplaceTempView(table)
        return unnest.sql(spark, to_spark(text))

    QUERIES[name], ORACLES[name] = run, oracle or text


def _frame(name: str, oracle: str | None) -> Callable[[Callable], Callable]:
    """A query of DataFrame operators; ``t`` gives a table by its name."""

    def register(build: Callable) -> Callable:
        QUERIES[name] = lambda spark, sf: build(lambda table: _table(spark, sf, table), spark)
        if oracle:
            ORACLES[name] = oracle
        return build

    return register


# scans, filters, projections
@_frame("scan_project", "select l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) as net from lineitem where l_quantity >= 45 and l_shipdate < timestamp '1996-01-01'")
def scan_project(t, spark):
    return project(where(t("lineitem"), "l_quantity >= 45", "l_shipdate < timestamp_ntz'1996-01-01'"), l_orderkey="l_orderkey", l_linenumber="l_linenumber", net="l_extendedprice * (1 - l_discount)")


@_frame("filter_3vl", "select c_custkey, c_acctbal > 0 or nullif(c_nationkey, 3) > 5 as p, (nullif(c_nationkey, 3) = 3) is null as unknown from customer where not (nullif(c_nationkey, 3) = 7 and c_acctbal < 100)")
def filter_3vl(t, spark):
    return project(where(t("customer"), "not (nullif(c_nationkey, 3) = 7 and c_acctbal < 100)"), c_custkey="c_custkey", p="c_acctbal > 0 or nullif(c_nationkey, 3) > 5", unknown="(nullif(c_nationkey, 3) = 3) is null")


_text("like_regexp", "select p_partkey, p_name from part where (p_name like '%a%e%' or regexp_contains(p_type, '^[A-M].*S')) and not starts_with(p_brand, 'Brand#1')", "select p_partkey, p_name from part where (p_name like '%a%e%' or regexp_matches(p_type, '^[A-M].*S')) and not starts_with(p_brand, 'Brand#1')")
_text("case_coalesce", "select o_orderkey, case o_orderstatus when 'F' then 1 when 'O' then 2 else 0 end as status, case when o_totalprice > 100000 then 'high' when o_totalprice > 50000 then 'middle' end as band, coalesce(nullif(o_orderstatus, 'F'), nullif(o_orderpriority, '1-URGENT'), 'none') as first_known, if(o_totalprice > 80000, o_orderpriority, o_orderstatus) as chosen, o_totalprice between 1000 and 50000 as inside, o_orderstatus in ('F', 'P') as listed from orders")
_text("between_is", "select l_orderkey, l_linenumber, (l_discount between 0.02 and 0.04) is true as a, (nullif(l_linestatus, 'O') = 'F') is false as b, nullif(l_linestatus, 'O') is null as c from lineitem where l_linenumber in (1, 2)")


# joins
@_frame("join_inner", "select n_name, r_name, s_suppkey from nation join region on n_regionkey = r_regionkey join supplier on s_nationkey = n_nationkey")
def join_inner(t, spark):
    both = joins.join(joins.join(t("nation"), t("region"), "n_regionkey = r_regionkey"), t("supplier"), "s_nationkey = n_nationkey")
    return both.select("n_name", "r_name", "s_suppkey")


# keys are NULL for one segment of the customers and for one status of the orders: unmatched rows on both sides
_CUSTOMERS = "(select c_custkey, nullif(c_custkey, if(c_mktsegment = 'BUILDING', c_custkey, -1)) as k, c_nationkey from customer) c"
_ORDERS = "(select o_orderkey, nullif(o_custkey, if(o_orderstatus = 'P', o_custkey, -1)) as j, o_totalprice from orders) o"
for _kind in ("left", "right", "full"):

    def _outer(t, spark, kind=_kind):
        customers = t("customer").selectExpr("c_custkey", "nullif(c_custkey, if(c_mktsegment = 'BUILDING', c_custkey, -1)) as k", "c_nationkey")
        orders = t("orders").selectExpr("o_orderkey", "nullif(o_custkey, if(o_orderstatus = 'P', o_custkey, -1)) as j", "o_totalprice")
        return joins.join(customers, orders, "j = k", kind)

    _frame(f"join_{_kind}", f"select * from {_CUSTOMERS} {_kind} join {_ORDERS} on j = k")(_outer)


@_frame("join_full_theta", "select a.n_name as a, b.r_name as b from nation a full join region b on n_regionkey < r_regionkey and r_regionkey < 3")
def join_full_theta(t, spark):
    return joins.join(t("nation"), t("region"), "n_regionkey < r_regionkey and r_regionkey < 3", "outer").select(F.col("n_name").alias("a"), F.col("r_name").alias("b"))


@_frame("join_cross", "select r_name, n_name from region, nation")
def join_cross(t, spark):
    return joins.join(t("region"), t("nation"), None).select("r_name", "n_name")


@_frame("join_theta", "select s_suppkey, n_name from supplier join nation on s_nationkey > n_nationkey and n_regionkey = 1")
def join_theta(t, spark):
    return joins.join(t("supplier"), t("nation"), "s_nationkey > n_nationkey and n_regionkey = 1").select("s_suppkey", "n_name")


@_frame("join_null_safe", "select a.o_orderkey, b.k from (select o_orderkey, nullif(o_orderstatus, 'P') as s from orders) a join (select distinct nullif(o_orderstatus, 'P') as k from orders) b on a.s is not distinct from b.k")
def join_null_safe(t, spark):
    status = t("orders").selectExpr("o_orderkey", "nullif(o_orderstatus, 'P') as s")
    keys = t("orders").selectExpr("nullif(o_orderstatus, 'P') as k").distinct()
    return joins.null_safe(status, keys, [("s", "k")]).select("o_orderkey", "k")


@_frame("join_using", "select n_regionkey as k, n_name, cnt from nation join (select n_regionkey, count(*) as cnt from nation group by n_regionkey) using (n_regionkey)")
def join_using(t, spark):
    return joins.join(t("nation"), aggregate(t("nation"), ["n_regionkey"], cnt=("count", "*")), ["n_regionkey"]).select(F.col("n_regionkey").alias("k"), "n_name", "cnt")


_text("join_multiway", "select n_name, sum(l_extendedprice * (1 - l_discount)) as revenue, count(*) as n from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey join supplier on l_suppkey = s_suppkey and c_nationkey = s_nationkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name like 'A%' group by n_name")


@_frame("semi_exists", "select o_orderkey from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R')")
def semi_exists(t, spark):
    return joins.join(t("orders"), t("lineitem").where("l_returnflag = 'R'"), "l_orderkey = o_orderkey", "semi").select("o_orderkey")


_text("semi_in", "select c_custkey from customer where c_custkey in (select o_custkey from orders where o_totalprice > 200000)")


@_frame("anti_not_exists", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def anti_not_exists(t, spark):
    return joins.join(t("customer"), t("orders"), "o_custkey = c_custkey", "anti").select("c_custkey")


_text("anti_not_in", "select c_custkey from customer where c_custkey not in (select o_custkey from orders)")
_text("anti_not_in_null", "select n_name from nation where n_regionkey not in (select nullif(r_regionkey, 1) from region where r_regionkey < 3)")
_text("single_scalar", "select s_suppkey, s_acctbal - (select avg(s_acctbal) from supplier) as above from supplier")
_text("single_correlated", "select o_orderkey, (select count(*) from lineitem where l_orderkey = o_orderkey) as lines, (select max(l_shipdate) from lineitem where l_orderkey = o_orderkey and l_quantity > 40) as last from orders")


@_frame("single_join", "select n_name, (select r_name from region where r_regionkey = n_regionkey and r_regionkey <> 2) as r from nation")
def single_join(t, spark):
    regions = t("region").where("r_regionkey <> 2").withColumnRenamed("r_regionkey", "n_regionkey")
    return joins.single(t("nation"), regions, ["n_regionkey"], "r_name", "r").select("n_name", "r")


_text("mark_or_exists", "select c_custkey from customer where c_acctbal < 0 or exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 250000)")


@_frame("mark_value", "select c_custkey, exists (select 1 from orders where o_custkey = c_custkey) as ordered from customer")
def mark_value(t, spark):
    return joins.mark(t("customer"), t("orders").withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"], "ordered").select("c_custkey", "ordered")


# inner subqueries that refer to the outermost query, over one level and more
_text("skip_level", "select r_name from region where exists (select 1 from nation where n_regionkey = r_regionkey and exists (select 1 from supplier where s_nationkey = n_nationkey and s_acctbal > 9000 + r_regionkey * 100))")
_text("skip_level_scalar", "select r_name, (select count(*) from nation where n_regionkey = r_regionkey and exists (select 1 from supplier where s_nationkey = n_nationkey and s_acctbal > r_regionkey * 2000)) as nations from region")
_text("skip_level_in", "select c_custkey from customer where c_nationkey in (select n_nationkey from nation where n_regionkey in (select r_regionkey from region where r_regionkey * 1000 < c_acctbal))")
_text("skip_two_levels", "select r_name from region r where exists (select 1 from nation n where n_regionkey = r.r_regionkey and exists (select 1 from supplier s where s_nationkey = n.n_nationkey and exists (select 1 from nation x where x.n_nationkey = s.s_nationkey and x.n_regionkey + r.r_regionkey > 3 and n.n_nationkey > r.r_regionkey)))")


# aggregation
@_frame("agg_simple", "select count(*) as n, sum(l_linenumber)::BIGINT as lines, avg(l_quantity) as quantity, min(l_shipdate) as first, max(l_comment) as last from (select *, l_returnflag as l_comment from lineitem)")
def agg_simple(t, spark):
    return aggregate(t("lineitem"), n=("count", "*"), lines=("sum", "l_linenumber"), quantity=("avg", "l_quantity"), first=("min", "l_shipdate"), last=("max", "l_returnflag"))


@_frame("agg_group", "select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, sum(l_extendedprice) as sum_base, sum(l_extendedprice * (1 - l_discount)) as sum_disc, avg(l_discount) as avg_disc, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by l_returnflag, l_linestatus")
def agg_group(t, spark):
    rows = where(t("lineitem"), "l_shipdate <= timestamp_ntz'1998-09-02'")
    return aggregate(rows, ["l_returnflag", "l_linestatus"], sum_qty=("sum", "l_quantity"), sum_base=("sum", "l_extendedprice"), sum_disc=("sum", "l_extendedprice * (1 - l_discount)"), avg_disc=("avg", "l_discount"), n=("count", "*"))


_text("agg_distinct", "select o_orderstatus, count(distinct o_custkey) as customers, count(distinct o_orderpriority) as priorities, sum(distinct o_custkey % 100) as s from orders group by o_orderstatus", "select o_orderstatus, count(distinct o_custkey) as customers, count(distinct o_orderpriority) as priorities, sum(distinct o_custkey % 100)::BIGINT as s from orders group by o_orderstatus")
_text("agg_logical", "select c_mktsegment, logical_and(c_acctbal > -900) as a, logical_or(c_acctbal > 9990) as o, logical_and(nullif(c_acctbal > 0, true)) as only_false from customer group by c_mktsegment", "select c_mktsegment, bool_and(c_acctbal > -900) as a, bool_or(c_acctbal > 9990) as o, bool_and(nullif(c_acctbal > 0, true)) as only_false from customer group by c_mktsegment")
_text("agg_minmax_all_types", "select event_type, min(ts) as a, max(ts) as b, min(value) as c, max(user_id) as d, min(props) as e, max(cast(ts as date)) as f, min(value > 50) as g from events group by event_type")
_text("agg_minmax_distinct", "select o_orderstatus, max(distinct o_totalprice) as a, min(distinct o_orderpriority) as b from orders group by o_orderstatus")
_text("agg_avg_distinct", "select l_returnflag, avg(distinct l_quantity) as a from lineitem group by l_returnflag")
_text("agg_empty", "select count(*) as n, count(l_tax) as c, sum(l_tax) as s, min(l_shipdate) as m, avg(l_quantity) as a from lineitem where l_quantity < 0")
_text("agg_group_null", "select nullif(o_orderstatus, 'O') as s, count(*) as n, count(nullif(o_orderstatus, 'O')) as known from orders group by nullif(o_orderstatus, 'O')")
_text("having_correlated", "select o_custkey, sum(o_totalprice) as total from orders group by o_custkey having sum(o_totalprice) > (select 40 * max(c_acctbal) from customer where c_custkey = o_custkey)")
_text("select_distinct", "select distinct l_returnflag, l_linestatus from lineitem")


# order, limit, union
@_frame("sort_topk", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20")
def sort_topk(t, spark):
    return limit(order(t("orders").select("o_orderkey", "o_totalprice"), "-o_totalprice", "o_orderkey"), 20)


@_frame("sort_nulls", "select o_orderkey, nullif(o_orderstatus, 'F') as s from orders order by s asc nulls first, o_orderkey desc")
def sort_nulls(t, spark):
    return order(t("orders").selectExpr("o_orderkey", "nullif(o_orderstatus, 'F') as s"), "s", "-o_orderkey")


@_frame("limit_offset", "select p_partkey, p_name from part order by p_partkey limit 10 offset 25")
def limit_offset(t, spark):
    return limit(order(t("part").select("p_partkey", "p_name"), "p_partkey"), 10, 25)


@_frame("union_all", "select n_name as name, n_nationkey as k from nation union all select r_name, r_regionkey from region union all select n_name, n_nationkey from nation where n_regionkey = 0")
def union(t, spark):
    nations = t("nation").selectExpr("n_name as name", "n_nationkey as k")
    return union_all(nations, t("region").select("r_name", "r_regionkey"), t("nation").where("n_regionkey = 0").select("n_name", "n_nationkey"))


_text("cte_multi", "with big as (select * from orders where o_totalprice > 200000), per as (select o_custkey, count(*) as n from big group by o_custkey) select c_name, n from per join customer on c_custkey = o_custkey where n >= (select max(n) - 1 from per)")
_text("cte_nested", "with a as (with a as (select n_nationkey as k from nation) select k + 1 as k from a where k < 10) select k from a where k in (select k from a where k > 3)")


@_frame("values_inline", "select * from (values (1::BIGINT, 'a', 1.5::DOUBLE), (2, NULL, -0.5), (NULL, 'c', NULL)) v(i, s, x)")
def values_inline(t, spark):
    return values(spark, {"i": "INTEGER", "s": "VARCHAR", "x": "DOUBLE"}, [(1, "a", 1.5), (2, None, -0.5), (None, "c", None)])


_text("select_except", "select * except (n_regionkey) from nation", "select * exclude (n_regionkey) from nation")

_text("select_replace", "select * replace (upper(n_name) as n_name, n_regionkey + n_nationkey as n_regionkey) from nation")

# functions
_text("fn_ifnull", "select c_custkey, ifnull(nullif(c_mktsegment, 'BUILDING'), 'none') as a, ifnull(nullif(c_nationkey, 3), -1) as b, - c_nationkey as c, - c_acctbal as d, -(-c_custkey) as e from customer")
_text("fn_error", "select o_orderkey, if(o_orderkey < 0, error(concat('negative key ', o_orderpriority)), o_orderkey) as k, coalesce(o_orderstatus, error('no status')) as s from orders", "select o_orderkey, o_orderkey as k, o_orderstatus as s from orders")
_text("fn_hash", "select count(*) as n, count(distinct hash(o_orderkey, o_orderstatus)) = count(distinct concat(cast(o_orderkey as string), o_orderstatus)) as tells_apart, logical_and(hash(o_custkey) = hash(o_custkey + 0)) as repeats, count(hash(o_comment)) as known from (select *, nullif(o_orderpriority, '5-LOW') as o_comment from orders)", "select count(*) as n, true as tells_apart, true as repeats, count(*) as known from orders")
_text("fn_now", "select n_nationkey, current_date() = cast(current_timestamp() as date) as same_day, current_timestamp() > timestamp '2020-01-01 00:00:00' as later, date_diff(current_date(), current_date(), day) as d from nation", "select n_nationkey, current_date = current_timestamp::DATE as same_day, true as later, 0::BIGINT as d from nation")
_text("fn_ts_convert", "select event_id, date(ts) as a, extract(date from ts) as b, string(ts) as c, cast(timestamp(cast(ts as date)) as timestamp_ntz) as d, cast(timestamp(format_timestamp('%Y-%m-%d %H:%M:%S', ts)) as timestamp_ntz) as e, cast(parse_timestamp('%Y-%m-%d %H:%M:%S', format_timestamp('%Y-%m-%d %H:%M:%S', ts)) as timestamp_ntz) as f from events", "select event_id, ts::DATE as a, ts::DATE as b, strftime(ts, '%Y-%m-%dT%H:%M:%S') || case when epoch_us(ts) % 1000000 = 0 then '' when epoch_us(ts) % 1000 = 0 then strftime(ts, '.%g') else strftime(ts, '.%f') end || '+00:00' as c, ts::DATE::TIMESTAMP as d, date_trunc('second', ts) as e, date_trunc('second', ts) as f from events")
_text("fn_ts_parts", "select event_id, extract(hour from ts) as a, extract(minute from ts) as b, extract(microsecond from ts) as c, extract(year from ts) as d, extract(isoweek from ts) as e, extract(week from ts) as f, extract(quarter from ts) as g, extract(dayofweek from ts) as h, cast(timestamp_trunc(ts, minute) as timestamp_ntz) as i, cast(timestamp_trunc(ts, second) as timestamp_ntz) as j, cast(timestamp_trunc(ts, day) as timestamp_ntz) as k, cast(timestamp_trunc(ts, year) as timestamp_ntz) as l, cast(timestamp_add(ts, interval 5 second) as timestamp_ntz) as m, cast(timestamp_add(ts, interval 7 millisecond) as timestamp_ntz) as n, cast(timestamp_sub(ts, interval 3 hour) as timestamp_ntz) as o, cast(timestamp_add(ts, interval 11 microsecond) as timestamp_ntz) as p, timestamp_diff(ts, timestamp '2024-01-01 00:00:00', second) as q, timestamp_diff(ts, timestamp '2024-01-01 00:00:00', millisecond) as r, timestamp_diff(ts, timestamp '2024-01-01 00:00:00', minute) as s, timestamp_diff(ts, timestamp '2024-01-01 00:00:00', microsecond) as t from events", "select event_id, hour(ts) as a, minute(ts) as b, epoch_us(ts) % 1000000 as c, year(ts) as d, weekofyear(ts) as e, strftime(ts, '%U')::BIGINT as f, quarter(ts) as g, dayofweek(ts) + 1 as h, date_trunc('minute', ts) as i, date_trunc('second', ts) as j, date_trunc('day', ts)::TIMESTAMP as k, date_trunc('year', ts)::TIMESTAMP as l, ts + interval 5 second as m, ts + interval 7 millisecond as n, ts - interval 3 hour as o, ts + interval 11 microsecond as p, trunc((epoch_us(ts) - epoch_us(timestamp '2024-01-01')) / 1000000)::BIGINT as q, trunc((epoch_us(ts) - epoch_us(timestamp '2024-01-01')) / 1000)::BIGINT as r, trunc((epoch_us(ts) - epoch_us(timestamp '2024-01-01')) / 60000000)::BIGINT as s, epoch_us(ts) - epoch_us(timestamp '2024-01-01') as t from events")
_text(
    "fn_string",
    "select p_partkey, length(p_name) as a, char_length(p_name) as b, byte_length(p_name) as c, upper(p_name) as d, lower(p_brand) as e, reverse(p_name) as f, concat(p_brand, '-', p_type) as g, replace(p_type, 'A', '__') as h, repeat(p_brand, 2) as i, left(p_name, 3) as j, right(p_name, 4) as k, strpos(p_name, 'e') as l, starts_with(p_type, 'S') as m, ends_with(p_type, 'L') as n, chr(p_size + 1000) as o, p_brand || p_name as p from part",
    "select p_partkey, length(p_name) as a, length(p_name) as b, strlen(p_name) as c, upper(p_name) as d, lower(p_brand) as e, reverse(p_name) as f, concat(p_brand, '-', p_type) as g, replace(p_type, 'A', '__') as h, repeat(p_brand, 2) as i, left(p_name, 3) as j, right(p_name, 4) as k, strpos(p_name, 'e') as l, starts_with(p_type, 'S') as m, ends_with(p_type, 'L') as n, chr(p_size + 1000) as o, p_brand || p_name as p from part",
)
_text("fn_string_pad", "select p_partkey, lpad(p_name, 12, '*') as a, rpad(p_name, 5, 'ab') as b, trim(concat('  ', p_name, ' \\t')) as c, ltrim(concat('xxy', p_name), 'xy') as d, rtrim(concat(p_name, 'zz'), 'z') as e, lpad(p_brand, 12) as f from part", "select p_partkey, lpad(p_name, 12, '*') as a, rpad(p_name, 5, 'ab') as b, regexp_replace(concat('  ', p_name, ' ', chr(9)), '^\\s+|\\s+$', '', 'g') as c, ltrim(concat('xxy', p_name), 'xy') as d, rtrim(concat(p_name, 'zz'), 'z') as e, lpad(p_brand, 12, ' ') as f from part")
_text("fn_substr", "select p_partkey, substr(p_name, 3) as a, substr(p_name, -3) as b, substr(p_name, 2, 4) as c, substr(p_name, -100, 2) as d, substr(p_name, 0, 2) as e, substr(p_name, 100) as f from part", "select p_partkey, substr(p_name, 3) as a, substr(p_name, -3) as b, substr(p_name, 2, 4) as c, substr(p_name, 1, 2) as d, substr(p_name, 1, case when length(p_name) > 0 then 2 else 0 end) as e, substr(p_name, 100) as f from part")
_text("fn_regexp", "select p_partkey, regexp_contains(p_name, '[aeiou]{2}') as a, regexp_extract(p_type, '[A-Z]+') as b, regexp_extract(p_brand, '#(\\\\d)') as c, regexp_replace(p_name, '([aeiou])', '<\\\\1>') as d, regexp_replace(p_name, 'a*', '-') as e from part", "select p_partkey, regexp_matches(p_name, '[aeiou]{2}') as a, case when regexp_matches(p_type, '[A-Z]+') then regexp_extract(p_type, '[A-Z]+') end as b, case when regexp_matches(p_brand, '#(\\d)') then regexp_extract(p_brand, '#(\\d)', 1) end as c, regexp_replace(p_name, '([aeiou])', '<\\1>', 'g') as d, regexp_replace(p_name, 'a*', '-', 'g') as e from part")
_text("fn_math", "select s_suppkey, abs(s_acctbal) as a, sign(s_acctbal) as b, sign(s_suppkey - 5) as c, mod(s_suppkey, 7) as d, div(s_suppkey, 3) as e, pow(s_nationkey, 2) as f, sqrt(abs(s_acctbal)) as g, exp(s_nationkey / 10) as h, ln(s_nationkey) as i, log10(s_nationkey) as j, log(s_suppkey, 2) as k, is_nan(ln(s_nationkey - 5)) as l, is_inf(ln(s_nationkey)) as m, greatest(s_suppkey, nullif(s_nationkey, 3)) as n, least(s_suppkey, nullif(s_nationkey, 3)) as o, -s_acctbal as p from supplier", "select s_suppkey, abs(s_acctbal) as a, sign(s_acctbal)::DOUBLE as b, sign(s_suppkey - 5)::BIGINT as c, s_suppkey % 7 as d, s_suppkey // 3 as e, pow(s_nationkey, 2) as f, sqrt(abs(s_acctbal)) as g, exp(s_nationkey / 10) as h, case when s_nationkey = 0 then '-inf'::DOUBLE else ln(s_nationkey) end as i, case when s_nationkey = 0 then '-inf'::DOUBLE else log10(s_nationkey) end as j, ln(s_suppkey) / ln(2) as k, s_nationkey < 5 as l, s_nationkey = 0 as m, case when s_nationkey <> 3 then greatest(s_suppkey, s_nationkey) end as n, case when s_nationkey <> 3 then least(s_suppkey, s_nationkey) end as o, -s_acctbal as p from supplier")
_text("fn_trig", "select n_nationkey, sin(n_nationkey) as a, cos(n_nationkey) as b, tan(n_nationkey) as c, asin(n_nationkey / 25) as d, acos(n_nationkey / 25) as e, atan(n_nationkey) as f, atan2(n_nationkey, 3) as g, sinh(n_nationkey / 10) as h, cosh(n_nationkey / 10) as i, tanh(n_nationkey / 10) as j, asinh(n_nationkey) as k, acosh(n_nationkey + 1) as l, atanh(n_nationkey / 30) as m from nation")
_text("fn_round_trunc", "select c_custkey, round(c_acctbal) + 0 as a, round(c_acctbal, 1) + 0 as b, round(c_acctbal, -2) + 0 as c, ceil(c_acctbal) as d, floor(c_acctbal) as e, trunc(c_acctbal) as f, trunc(c_acctbal / 7, 1) as g from customer", "select c_custkey, round(c_acctbal) + 0 as a, round(c_acctbal, 1) + 0 as b, round(c_acctbal, -2) + 0 as c, ceil(c_acctbal)::DOUBLE as d, floor(c_acctbal)::DOUBLE as e, trunc(c_acctbal)::DOUBLE as f, trunc(c_acctbal / 7 * 10) / 10 as g from customer")
_DAY = "cast(o_orderdate as date)"
_text("fn_date_extract", f"select o_orderkey, extract(year from {_DAY}) as a, extract(month from {_DAY}) as b, extract(day from {_DAY}) as c, extract(quarter from {_DAY}) as d, extract(dayofweek from {_DAY}) as e, extract(dayofyear from {_DAY}) as f, extract(isoweek from {_DAY}) as g, extract(isoyear from {_DAY}) as h, extract(week from {_DAY}) as i, extract(week(monday) from {_DAY}) as j from orders", f"select o_orderkey, year({_DAY}) as a, month({_DAY}) as b, day({_DAY}) as c, quarter({_DAY}) as d, dayofweek({_DAY}) + 1 as e, dayofyear({_DAY}) as f, weekofyear({_DAY}) as g, isoyear({_DAY}) as h, strftime({_DAY}, '%U')::BIGINT as i, strftime({_DAY}, '%W')::BIGINT as j from orders")
_text("fn_date_trunc", f"select o_orderkey, date_trunc({_DAY}, year) as a, date_trunc({_DAY}, quarter) as b, date_trunc({_DAY}, month) as c, date_trunc({_DAY}, isoweek) as d, date_trunc({_DAY}, week) as e, date_trunc({_DAY}, isoyear) as f, date_trunc({_DAY}, day) as g from orders", f"select o_orderkey, date_trunc('year', {_DAY})::DATE as a, date_trunc('quarter', {_DAY})::DATE as b, date_trunc('month', {_DAY})::DATE as c, date_trunc('week', {_DAY})::DATE as d, ({_DAY} - dayofweek({_DAY})::INTEGER)::DATE as e, date_trunc('week', make_date(isoyear({_DAY}), 1, 4))::DATE as f, {_DAY} as g from orders")
_text("fn_date_add", f"select o_orderkey, date_add({_DAY}, interval 10 day) as a, date_add({_DAY}, interval 2 week) as b, date_add({_DAY}, interval 1 month) as c, date_sub({_DAY}, interval 1 quarter) as d, date_sub({_DAY}, interval 3 year) as e, date_add({_DAY}, interval o_orderkey % 50 day) as f from orders", f"select o_orderkey, ({_DAY} + interval 10 day)::DATE as a, ({_DAY} + interval 14 day)::DATE as b, ({_DAY} + interval 1 month)::DATE as c, ({_DAY} - interval 3 month)::DATE as d, ({_DAY} - interval 3 year)::DATE as e, ({_DAY} + (o_orderkey % 50)::INTEGER)::DATE as f from orders")
_text("fn_date_diff", f"select o_orderkey, date_diff({_DAY}, date '1995-06-17', day) as a, date_diff({_DAY}, date '1995-06-17', month) as b, date_diff({_DAY}, date '1995-06-17', year) as c, date_diff({_DAY}, date '1995-06-17', isoweek) as d, date_diff({_DAY}, date '1995-06-17', quarter) as e from orders", f"select o_orderkey, date_diff('day', date '1995-06-17', {_DAY}) as a, date_diff('month', date '1995-06-17', {_DAY}) as b, date_diff('year', date '1995-06-17', {_DAY}) as c, date_diff('day', date '1995-06-12', date_trunc('week', {_DAY})::DATE) // 7 as d, (year({_DAY}) - 1995) * 4 + quarter({_DAY}) - 2 as e from orders")
_text("fn_date_parts", f"select o_orderkey, date_trunc({_DAY}, week(monday)) as a, date_trunc({_DAY}, week(wednesday)) as b, extract(week(wednesday) from {_DAY}) as c, date_diff({_DAY}, date '1995-06-17', week) as d, date_diff({_DAY}, date '1995-06-17', week(monday)) as e, date_diff({_DAY}, date '1995-06-17', week(saturday)) as f, date_diff({_DAY}, date '1995-06-17', isoyear) as g, date_sub({_DAY}, interval 10 day) as h, date_sub({_DAY}, interval 3 week) as i, date_sub({_DAY}, interval 2 month) as j, date_add({_DAY}, interval 1 quarter) as k, date_add({_DAY}, interval 4 year) as l, date_add({_DAY}, interval -1 month) as m from orders", f"select o_orderkey, date_trunc('week', {_DAY})::DATE as a, ({_DAY} - ((dayofweek({_DAY}) + 4) % 7)::INTEGER)::DATE as b, (dayofyear({_DAY}) + 6 - (dayofweek({_DAY}) + 4) % 7) // 7 as c, date_diff('day', date '1995-06-11', ({_DAY} - dayofweek({_DAY})::INTEGER)::DATE) // 7 as d, date_diff('day', date '1995-06-12', date_trunc('week', {_DAY})::DATE) // 7 as e, date_diff('day', date '1995-06-17', ({_DAY} - ((dayofweek({_DAY}) + 1) % 7)::INTEGER)::DATE) // 7 as f, isoyear({_DAY}) - 1995 as g, ({_DAY} - 10)::DATE as h, ({_DAY} - 21)::DATE as i, ({_DAY} - interval 2 month)::DATE as j, ({_DAY} + interval 3 month)::DATE as k, ({_DAY} + interval 4 year)::DATE as l, ({_DAY} - interval 1 month)::DATE as m from orders")
_text("fn_ts_calendar", "select event_id, extract(month from ts) as a, extract(day from ts) as b, extract(dayofyear from ts) as c, extract(isoyear from ts) as d, extract(week(monday) from ts) as e, cast(timestamp_trunc(ts, week) as timestamp_ntz) as f, cast(timestamp_trunc(ts, isoweek) as timestamp_ntz) as g, cast(timestamp_trunc(ts, quarter) as timestamp_ntz) as h, cast(timestamp_trunc(ts, isoyear) as timestamp_ntz) as i, cast(timestamp_trunc(ts, millisecond) as timestamp_ntz) as j, cast(timestamp_trunc(ts, microsecond) as timestamp_ntz) as k from events", "select event_id, month(ts) as a, day(ts) as b, dayofyear(ts) as c, isoyear(ts) as d, strftime(ts, '%W')::BIGINT as e, (ts::DATE - dayofweek(ts)::INTEGER)::TIMESTAMP as f, date_trunc('week', ts)::TIMESTAMP as g, date_trunc('quarter', ts)::TIMESTAMP as h, date_trunc('week', make_date(isoyear(ts), 1, 4))::TIMESTAMP as i, date_trunc('millisecond', ts) as j, ts as k from events")
_text("fn_ts_arith", "select event_id, cast(timestamp_add(ts, interval 90 minute) as timestamp_ntz) as a, cast(timestamp_sub(ts, interval 1 day) as timestamp_ntz) as b, timestamp_diff(timestamp '2024-06-01 12:00:00', ts, hour) as c, timestamp_diff(timestamp '2024-06-01 12:00:00', ts, day) as d, cast(timestamp_trunc(ts, hour) as timestamp_ntz) as e, cast(timestamp_trunc(ts, month) as timestamp_ntz) as f, extract(second from ts) as g, extract(millisecond from ts) as h from events", "select event_id, ts + interval 90 minute as a, ts - interval 1 day as b, cast(trunc((epoch_us(timestamp '2024-06-01 12:00:00') - epoch_us(ts)) / 3600000000) as BIGINT) as c, date_diff('day', ts::DATE, date '2024-06-01') as d, date_trunc('hour', ts) as e, date_trunc('month', ts)::TIMESTAMP as f, second(ts) as g, (epoch_us(ts) % 1000000) // 1000 as h from events")
_text("fn_ts_epoch", "select event_id, unix_micros(ts) as a, unix_millis(ts) as b, unix_date(cast(ts as date)) as c, date_from_unix_date(event_id % 20000) as d, cast(timestamp_from_unix_micros(event_id * 1000003) as timestamp_ntz) as e, date(2020, 1 + event_id % 12, 1 + event_id % 28) as f from events", "select event_id, epoch_us(ts) as a, epoch_us(ts) // 1000 as b, date_diff('day', date '1970-01-01', ts::DATE) as c, (date '1970-01-01' + (event_id % 20000)::INTEGER)::DATE as d, make_timestamp(event_id * 1000003) as e, make_date(2020, 1 + event_id % 12, 1 + event_id % 28) as f from events")
_text("fn_format_parse", f"select o_orderkey, format_date('%Y/%m/%d', {_DAY}) as a, format_date('%b %d, %y', {_DAY}) as b, format_timestamp('%H:%M', o_orderdate) as c, parse_date('%d.%m.%Y', concat(lpad(cast(1 + o_orderkey % 28 as string), 2, '0'), '.02.2021')) as d, string({_DAY}) as e from orders", f"select o_orderkey, strftime({_DAY}, '%Y/%m/%d') as a, strftime({_DAY}, '%b %d, %y') as b, strftime(o_orderdate, '%H:%M') as c, make_date(2021, 2, 1 + o_orderkey % 28) as d, strftime({_DAY}, '%Y-%m-%d') as e from orders")
_text("fn_cast", "select l_orderkey, l_linenumber, cast(l_quantity as string) as a, cast(l_linenumber > 2 as int64) as b, cast(l_quantity as int64) as c, cast('12' as int64) + l_linenumber as d, cast(cast(l_shipdate as date) as string) as e, cast(l_linenumber as bool) as f, cast(l_discount as string) as g, cast('true' as bool) as h from lineitem", "select l_orderkey, l_linenumber, l_quantity::BIGINT::VARCHAR as a, (l_linenumber > 2)::BIGINT as b, trunc(l_quantity)::BIGINT as c, 12 + l_linenumber::BIGINT as d, strftime(l_shipdate, '%Y-%m-%d') as e, true as f, case when l_discount = 0 then '0' else l_discount::VARCHAR end as g, true as h from lineitem")


# the catalog, changes and scripts
def _engine(spark: SparkSession) -> Engine:
    """A catalog in a folder of its own, under the folder that all executors share."""
    import tempfile
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="brindle-")
    return Engine(spark, f"{root}/catalog-{uuid.uuid4().hex}")


def _script(name: str, script: str, oracle: str | None, sources: tuple[str, ...] = (), params: dict | None = None) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        engine = _engine(spark)
        for table in sources:
            _table(engine.spark, sf, table).createOrReplaceTempView(f"src_{table}")
        return engine.sql(script, params)

    QUERIES[name] = run
    if oracle:
        ORACLES[name] = oracle


_COPY = "create table t(k integer, s varchar, x double); insert into t select c_custkey, c_name, c_nationkey * 1.5 from src_customer;"
_COPIED = "select c_custkey::BIGINT as k, c_name as s, (c_nationkey * 1.5)::DOUBLE as x from customer"
_script("dml_insert_select", _COPY + "insert into t(s, k) values ('new', -100), (null, -101); insert t values (-102, 'without into', 1); select * from t", _COPIED + " union all values (-100, 'new', null), (-101, null, null), (-102, 'without into', 1)", ("customer",))
_script("dml_update_from", _COPY + "update t set s = concat(s, '/', n_name), x = x + 1 from src_nation where n_nationkey * 1.5 = x and n_regionkey < 3; select * from t", "select c_custkey::BIGINT as k, case when n_regionkey < 3 then c_name || '/' || n_name else c_name end as s, (c_nationkey * 1.5 + case when n_regionkey < 3 then 1 else 0 end)::DOUBLE as x from customer join nation on c_nationkey = n_nationkey", ("customer", "nation"))
_script("dml_delete", _COPY + "delete from t where k in (select max(k) from t) or x > 4; select * from t", f"select * from ({_COPIED}) where k <> (select max(c_custkey) from customer) and x <= 4", ("customer",))
_script("ddl_drop", "create schema a; create database a.b; create table a.b.t(i integer); create table u(i integer); create index x on u(i); insert into a.b.t values (1), (2); drop index x; drop table u; create table u(j varchar); insert into u values ('again'); drop table a.b.t; create table a.b.t(i integer); insert into a.b.t values (3); drop database a.b; create database a.b; select (select count(*) from metadata.catalog) as databases, (select count(*) from metadata.table) as tables, (select count(*) from metadata.index) as indexes, j from u", "select 3::BIGINT as databases, 1::BIGINT as tables, 0::BIGINT as indexes, 'again' as j")
_script("metadata_index_column", "create table t(a integer, b varchar, c double); create index i on t(c, a); create index j on t(b); select i.index_name as idx, l.column_name as col, x.index_order as nth from metadata.index_column as x join metadata.index as i on i.index_id = x.index_id join metadata.column as l on l.table_id = i.table_id and l.column_id = x.column_id", "select * from (values ('i', 'c', 0::BIGINT), ('i', 'a', 1), ('j', 'b', 0)) v(idx, col, nth)")
_script("qualified_names", "create database shop; create table shop.item(id integer, name varchar); insert into shop.item values (1, 'from shop.item where'), (2, 'metadata.table'); select shop.item.id, shop.item.name, 'from shop.item where' as v, 'metadata.table' as w from shop.item where shop.item.id > 0", "select * from (values (1::BIGINT, 'from shop.item where', 'from shop.item where', 'metadata.table'), (2, 'metadata.table', 'from shop.item where', 'metadata.table')) v(id, name, v, w)")
_script("index_lookup", _COPY + "create index by_x on t(x, k); insert into t values (-1, 'late', 6); update t set s = upper(s) where x = 6; select k, s from t where x = 6 and k < 1000", "select k, upper(s) as s from (" + _COPIED + " union all values (-1, 'late', 6.0)) where x = 6 and k < 1000", ("customer",))
_script("index_join", "create table t(k integer, o integer); insert into t select o_custkey, o_orderkey from src_orders; create index by_k on t(k); select c_name, o from src_customer join t on k = c_custkey where c_acctbal > 9000", "select c_name, o_orderkey as o from customer join orders on o_custkey = c_custkey where c_acctbal > 9000", ("customer", "orders"))
_script("call_ids", "create table t(i integer); create index x on t(i); insert into t values (5); call create_table(100); call create_index(100); select i, next_catalog_id() as c, next_table_id() as n, next_index_id() as x from t", "select 5::BIGINT as i, 100 as c, 101 as n, 101 as x")


def _transaction(spark: SparkSession, sf: str) -> DataFrame:
    engine = _engine(spark)
    _table(engine.spark, sf, "customer").createOrReplaceTempView("src_customer")
    engine.sql(_COPY + "create table log(what varchar, id integer)")
    with engine.transaction():
        engine.sql("delete from t where x > 4; insert into log select 'left', count(*) from t; insert into log values ('transaction', xid())")
    try:
        with engine.transaction():
            engine.sql("delete from t where true; insert into log values ('never', 0); assert false")
    except AssertionError:
        pass
    return engine.sql("select what, id, (select count(*) from t) as n from log")


QUERIES["transaction"] = _transaction
ORACLES["transaction"] = f"with t as (select * from ({_COPIED}) where x <= 4) select 'left' as what, count(*) as id, count(*) as n from t union all select 'transaction', 1, count(*) from t"


def _traced(spark: SparkSession, sf: str) -> DataFrame:
    import json

    engine = _engine(spark)
    _table(engine.spark, sf, "nation").createOrReplaceTempView("src_nation")
    events = json.loads(engine.trace("select n_regionkey, count(*) as n from src_nation group by n_regionkey"))["traceEvents"]
    names = {e["name"].split(" ")[0] for e in events}
    rows = [(x, x in names) for x in ("query", "analysis", "optimization", "planning", "HashAggregate", "Scan")]
    return spark.createDataFrame([*rows, ("rows", events[0]["args"]["rows"] == 5)], "span string, there boolean")


QUERIES["trace"] = _traced
ORACLES["trace"] = "select unnest(['query', 'analysis', 'optimization', 'planning', 'HashAggregate', 'Scan', 'rows']) as span, true as there"


def _snapshot(spark: SparkSession, sf: str) -> DataFrame:
    engine = _engine(spark)
    _table(engine.spark, sf, "customer").createOrReplaceTempView("src_customer")
    engine.sql(_COPY)
    before = engine.snapshot("t")
    engine.sql("delete from t where k < 10; insert into t values (7, 'late', 0.5)")
    old, new = engine.table("t", before), engine.table("t")
    return old.withColumn("v", F.lit("old")).unionAll(new.withColumn("v", F.lit("new")))


QUERIES["snapshot_read"] = _snapshot
ORACLES["snapshot_read"] = f"with t as ({_COPIED}) select *, 'old' as v from t union all select *, 'new' as v from t where k >= 10 union all select 7, 'late', 0.5, 'new'"
_script("metadata_catalog", "create database shop; create table shop.item(id integer, name varchar); create index by_id on shop.item(id); select c.catalog_name as db, t.table_name as tab, l.column_name as col, l.column_type as kind, i.index_name as idx from metadata.catalog as c join metadata.table as t on t.catalog_id = c.catalog_id join metadata.column as l on l.table_id = t.table_id left join metadata.index as i on i.table_id = t.table_id", "select * from (values ('shop', 'item', 'id', 'BIGINT', 'by_id'), ('shop', 'item', 'name', 'STRING', 'by_id')) v(db, tab, col, kind, idx)")
_script("params", "select n_name, n_nationkey * @factor as k from src_nation where n_name > @least", "select n_name, n_nationkey * 3 as k from nation where n_name > 'G'", ("nation",), {"factor": 3, "least": "G"})
_script("script_assert", "create table t(i integer); insert into t values (1), (2), (3); assert (select count(*) from t) = 3 as 'three rows'; select sum(i) as s from t,", "select 6::BIGINT as s")


def _explained(spark: SparkSession, sf: str) -> DataFrame:
    engine = _engine(spark)
    _table(engine.spark, sf, "nation").createOrReplaceTempView("src_nation")
    plan = engine.sql("explain select n_name from src_nation where n_nationkey = 3")
    return plan.selectExpr("plan like '%Scan parquet%' as scans", "plan like '%PushedFilters%EqualTo(n_nationkey,3)%' as pushes", "count(*) over () as n")


QUERIES["explain"] = _explained
ORACLES["explain"] = "select true as scans, true as pushes, 1::BIGINT as n"
# single-valued groups: any row's value is the same
_text("any_value", "select n_nationkey, any_value(n_name) as name, any_value(s_nationkey + 1) as k, any_value(nullif(n_nationkey, n_nationkey)) as nothing from nation left join supplier on s_nationkey = n_nationkey group by n_nationkey")


_COLUMNS = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split()


def _estimates(spark: SparkSession, sf: str) -> DataFrame:
    """HyperLogLog++ against exact counts, for every column: within four times its standard error."""
    lines = _table(spark, sf, "lineitem")
    found = stats.summarise(lines)["columns"]
    exact = lines.agg(*[F.count_distinct(f"`{c}`").alias(c) for c in lines.columns]).first()
    return spark.createDataFrame([(c, exact[c], abs(s["distinct"] - exact[c]) <= max(2, 0.2 * exact[c])) for c, s in found.items()], "col string, distinct_values bigint, near boolean")


def _quantiles(spark: SparkSession, sf: str) -> DataFrame:
    """Quantiles of every number column: how many steps, ascending, from the least to the greatest value."""
    lines = _table(spark, sf, "lineitem")
    found = {c: s["quantiles"] for c, s in stats.summarise(lines)["columns"].items() if s["quantiles"]}
    ends = lines.agg(*[f(f"`{c}`").cast("double").alias(f"{n}_{c}") for c in found for n, f in (("lo", F.min), ("hi", F.max))]).first()
    return spark.createDataFrame([(c, q == sorted(q), q[0] >= ends[f"lo_{c}"] and q[-1] <= ends[f"hi_{c}"]) for c, q in found.items()], "col string, ascending boolean, inside boolean")


QUERIES["stats_ndv"], QUERIES["stats_quantile"] = _estimates, _quantiles
ORACLES["stats_ndv"] = " union all ".join(f"select '{c}' as col, count(distinct {c}) as distinct_values, true as near from lineitem" for c in _COLUMNS)
ORACLES["stats_quantile"] = f"select unnest({_COLUMNS[:8]}) as col, true as ascending, true as inside"
