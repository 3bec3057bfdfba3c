"""Named queries over the star schema and the event stream: recipes, statistics and timelines, with the SQL they must equal."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.columns import col, moment, num
from .operators import stats, timeline
from .operators.profile import assumed, duplicate_rows, profile_frame, understood, value_counts
from .plans.recipe import parse, run
from .plans.steps import PARTS
from .scratch import Written
from .sources.readers import of_frame, read_parquet
from .table import Table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

GAPPED = {
    "events": "case when event_id % 7 = 0 then null else value end as value, case when event_id % 5 = 0 then null else event_type end as event_type",
    "lineitem": "case when l_quantity = 1 then null else l_quantity end as l_quantity",
    "orders": "case when o_orderkey % 11 = 0 then null else o_orderpriority end as o_orderpriority, case when o_orderkey % 13 = 0 then null else o_totalprice end as o_totalprice",
}


def load(spark: SparkSession, sf_dir: str, name: str, gaps: bool = False, **kinds: str) -> Table:
    """A table as it lies there, or with gaps made at fixed rows (the data have none)."""
    table = read_parquet(spark, f"{sf_dir}/{name}.parquet")
    if gaps:
        made = [F.expr(x) for x in GAPPED[name].split(", case")[:1]] + [F.expr("case" + x) for x in GAPPED[name].split(", case")[1:]]
        names = {x.rsplit(" as ", 1)[1]: e for x, e in zip(GAPPED[name].replace(", case", "\ncase").split("\n"), made, strict=True)}
        table = table.with_frame(table.frame.select(*(names.get(c, F.col(c)) if c in names else F.col(c) for c in table.frame.columns)))
    return assumed(table, **kinds)


def gapped(name: str) -> str:
    return f"(select * replace ({', '.join(_replacements(name))}) from {name})"


def _replacements(name: str) -> list[str]:
    return [x if x.startswith("case") else f"case{x}" for x in GAPPED[name].split(", case")]


def steps(table: Table, *told: dict[str, Any]) -> Table:
    out = run(table, parse({"steps": list(told)}))
    if out.refusal:
        raise ValueError(out.refusal.reason)
    return out.table


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(query: Query) -> Query:
        QUERIES[name] = query
        if sql:
            ORACLE_SQL[name] = sql
        return query

    return keep


def recipe(name: str, table: str, told: list[dict[str, Any]], sql: str, gaps: bool = False, select: str | None = None, **kinds: str) -> None:
    """A query that is a recipe; select rounds or trims its result."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = steps(load(spark, sf_dir, table, gaps, **kinds), *told).visible()
        return out.selectExpr(*select.split("; ")) if select else out

    register(name, sql)(query)


def filtered(name: str, table: str, clauses: list[dict[str, Any]], where: str, columns: str, gaps: bool = False, combine: str = "and", **kinds: str) -> None:
    told = [{"op": "filter_rows", "clauses": clauses, "combine": combine}, {"op": "select_columns", "columns": columns.split(", ")}]
    recipe(name, table, told, f"select {columns} from {gapped(table) if gaps else table} where {where}", gaps, **kinds)


ORDER_COLUMNS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"
recipe("select_columns", "orders", [{"op": "select_columns", "columns": ["o_totalprice", "o_orderkey"]}], "select o_totalprice, o_orderkey from orders")
recipe("drop_columns", "orders", [{"op": "drop_columns", "columns": ["o_totalprice", "o_orderdate"]}], "select o_orderkey, o_custkey, o_orderstatus, o_orderpriority from orders")
recipe("rename_column", "nation", [{"op": "rename_column", "column": "n_name", "to": " country "}], "select n_nationkey, n_name as country, n_regionkey from nation")

filtered("filter_eq", "orders", [{"column": "o_orderstatus", "operator": "eq", "value": "F"}], "o_orderstatus = 'F'", "o_orderkey, o_orderstatus")
filtered("filter_ne", "events", [{"column": "event_type", "operator": "ne", "value": "click"}], "event_type is not null and event_type <> 'click'", "event_id, event_type", True)
filtered("filter_lt", "orders", [{"column": "o_totalprice", "operator": "lt", "value": 50000}], "o_totalprice < 50000", "o_orderkey, o_totalprice", True)
filtered("filter_lte", "lineitem", [{"column": "l_quantity", "operator": "lte", "value": 5}], "l_quantity <= 5", "l_orderkey, l_quantity, l_extendedprice", True)
filtered("filter_gt", "orders", [{"column": "o_orderdate", "operator": "gt", "value": "2000-06-30"}], "o_orderdate > timestamp '2000-06-30'", "o_orderkey, o_orderdate")
filtered("filter_gte", "events", [{"column": "value", "operator": "gte", "value": 50}], "value >= 50", "event_id, value", True)
filtered("filter_contains_literal", "part", [{"column": "p_name", "operator": "contains", "value": "A"}], "contains(upper(p_name), 'A')", "p_partkey, p_name")
filtered("filter_in", "orders", [{"column": "o_orderpriority", "operator": "in", "value": ["1-URGENT", "2-HIGH"]}], "o_orderpriority in ('1-URGENT', '2-HIGH')", "o_orderkey, o_orderpriority", True)
filtered("filter_not_in", "orders", [{"column": "o_orderpriority", "operator": "not_in", "value": ["1-URGENT", "2-HIGH"]}], "o_orderpriority is not null and o_orderpriority not in ('1-URGENT', '2-HIGH')", "o_orderkey, o_orderpriority", True)
filtered("filter_is_missing", "events", [{"column": "value", "operator": "is_missing"}], "value is null", "event_id", True)
filtered("filter_not_missing", "events", [{"column": "value", "operator": "not_missing"}], "value is not null", "event_id, value", True)
filtered("filter_and", "orders", [{"column": "o_orderstatus", "operator": "eq", "value": "O"}, {"column": "o_totalprice", "operator": "gt", "value": 200000}], "o_orderstatus = 'O' and o_totalprice > 200000", "o_orderkey, o_totalprice")
filtered("filter_or", "orders", [{"column": "o_orderstatus", "operator": "eq", "value": "P"}, {"column": "o_totalprice", "operator": "is_missing"}], "coalesce(o_orderstatus = 'P', false) or o_totalprice is null", "o_orderkey, o_totalprice", True, "or")

_SUM = {"op": "aggregate", "group_by": ["l_returnflag"], "aggregations": [{"function": "sum", "column": "l_extendedprice", "name": "total"}]}
recipe("having", "lineitem", [_SUM, {"op": "filter_rows", "clauses": [{"column": "total", "operator": "gt", "value": 1000}]}], "select l_returnflag, round(sum(l_extendedprice), 2) as total from lineitem group by 1 having sum(l_extendedprice) > 1000", select="l_returnflag; round(total, 2) as total")
recipe("limit_head", "orders", [{"op": "sort_rows", "columns": ["o_orderdate"]}, {"op": "sort_rows", "columns": ["o_orderkey"], "order": "desc"}, {"op": "limit_rows", "count": 25}], f"select {ORDER_COLUMNS} from orders order by o_orderkey desc limit 25")
recipe("limit_sample_seeded", "orders", [{"op": "limit_rows", "count": 100, "method": "sample", "seed": 7, "key": "o_orderkey"}], f"select {ORDER_COLUMNS} from orders order by md5('7:' || o_orderkey) limit 100")
recipe("top_k", "orders", [{"op": "aggregate", "group_by": ["o_orderpriority"], "aggregations": [{"function": "mean", "column": "o_totalprice", "name": "average"}]}, {"op": "sort_rows", "columns": ["average"], "order": "desc"}, {"op": "limit_rows", "count": 2}], "select o_orderpriority, round(avg(o_totalprice), 4) as average from orders group by 1 order by avg(o_totalprice) desc limit 2", select="o_orderpriority; round(average, 4) as average")
recipe("drop_missing_any", "events", [{"op": "drop_missing", "columns": ["value", "event_type"]}, {"op": "select_columns", "columns": ["event_id", "value"]}], f"select event_id, value from {gapped('events')} where value is not null and event_type is not null", True)
recipe("drop_missing_all", "events", [{"op": "drop_missing", "columns": ["value", "event_type"], "how": "all"}, {"op": "select_columns", "columns": ["event_id", "value"]}], f"select event_id, value from {gapped('events')} where value is not null or event_type is not null", True)
recipe("fill_median", "events", [{"op": "fill_missing", "column": "value", "method": "median"}], f"select event_id, round(coalesce(value, (select quantile_cont(value, 0.5) from {gapped('events')})), 6) as value from {gapped('events')}", True, "event_id; round(value, 6) as value")
recipe("fill_mean", "events", [{"op": "fill_missing", "column": "value", "method": "mean"}], f"select event_id, round(coalesce(value, (select avg(value) from {gapped('events')})), 6) as value from {gapped('events')}", True, "event_id; round(value, 6) as value")
recipe("fill_mode", "orders", [{"op": "fill_missing", "column": "o_orderpriority", "method": "mode"}, {"op": "select_columns", "columns": ["o_orderkey", "o_orderpriority"]}], f"select o_orderkey, coalesce(o_orderpriority, (select o_orderpriority from {gapped('orders')} where o_orderpriority is not null group by 1 order by count(*) desc, 1 limit 1)) as o_orderpriority from {gapped('orders')}", True)
recipe("fill_constant", "orders", [{"op": "fill_missing", "column": "o_totalprice", "method": "constant", "value": -1}, {"op": "select_columns", "columns": ["o_orderkey", "o_totalprice"]}], f"select o_orderkey, coalesce(o_totalprice, -1) as o_totalprice from {gapped('orders')}", True)
recipe("fill_forward", "events", [{"op": "sort_rows", "columns": ["event_id"]}, {"op": "fill_missing", "column": "value", "method": "forward"}, {"op": "select_columns", "columns": ["event_id", "value"]}], f"select event_id, last_value(value ignore nulls) over (order by event_id rows between unbounded preceding and current row) as value from {gapped('events')}", True)
recipe("drop_duplicates_first", "orders", [{"op": "sort_rows", "columns": ["o_orderkey"]}, {"op": "drop_duplicates", "columns": ["o_custkey"]}, {"op": "select_columns", "columns": ["o_custkey", "o_orderkey"]}], "select o_custkey, min(o_orderkey) as o_orderkey from orders group by 1")
recipe("drop_duplicates_rows", "lineitem", [{"op": "select_columns", "columns": ["l_returnflag", "l_linestatus", "l_quantity"]}, {"op": "drop_duplicates"}], f"select distinct l_returnflag, l_linestatus, l_quantity from {gapped('lineitem')}", True)
recipe("cast_numeric", "orders", [{"op": "derive_column", "name": "month", "expression": {"kind": "datetime_part", "column": "o_orderdate", "part": "month"}}, {"op": "cast_column", "column": "month", "to": "numeric"}, {"op": "select_columns", "columns": ["o_orderkey", "month"]}], "select o_orderkey, cast(strftime(o_orderdate, '%m') as double) as month from orders")
recipe("cast_text", "lineitem", [{"op": "cast_column", "column": "l_quantity", "to": "text"}, {"op": "select_columns", "columns": ["l_orderkey", "l_quantity"]}], "select l_orderkey, cast(l_quantity as varchar) as l_quantity from lineitem")
recipe("cast_datetime", "orders", [{"op": "derive_column", "name": "day", "expression": {"kind": "datetime_part", "column": "o_orderdate", "part": "year_month"}}, {"op": "cast_column", "column": "day", "to": "datetime"}, {"op": "select_columns", "columns": ["o_orderkey", "day"]}], "select o_orderkey, cast(date_trunc('month', o_orderdate) as timestamp) as day from orders")

_COLUMN = lambda n: {"kind": "column", "name": n}
for _name, _operator, _sql in (("derive_add", "add", "l_quantity + l_tax"), ("derive_sub", "subtract", "l_quantity - l_tax"), ("derive_mul", "multiply", "l_quantity * l_tax"), ("derive_div_safe", "divide", "l_quantity / nullif(l_tax, 0)")):
    recipe(
        _name, "lineitem", [{"op": "derive_column", "name": "made", "expression": {"kind": "arithmetic", "left": _COLUMN("l_quantity"), "operator": _operator, "right": _COLUMN("l_tax")}}],
        f"select l_orderkey, l_linenumber, l_partkey, round({_sql}, 6) as made from {gapped('lineitem')}", True, "l_orderkey; l_linenumber; l_partkey; round(made, 6) as made",
    )
recipe("bin_edges", "lineitem", [{"op": "derive_column", "name": "size", "expression": {"kind": "bin", "column": "l_quantity", "edges": [0, 10, 25, 40], "labels": ["small", "medium", "large"]}}, {"op": "aggregate", "group_by": ["size"], "aggregations": [{"function": "count"}]}], f"select case when l_quantity > 0 and l_quantity <= 10 then 'small' when l_quantity > 10 and l_quantity <= 25 then 'medium' when l_quantity > 25 and l_quantity <= 40 then 'large' end as size, count(*) as row_count from {gapped('lineitem')} group by 1 having size is not null", True)
recipe("bin_quantiles", "orders", [{"op": "derive_column", "name": "quarter", "expression": {"kind": "bin", "column": "o_totalprice", "quantiles": 4, "labels": ["q1", "q2", "q3", "q4"]}}, {"op": "select_columns", "columns": ["o_orderkey", "quarter"]}], f"with q as (select quantile_cont(o_totalprice, 0.25) as a, quantile_cont(o_totalprice, 0.5) as b, quantile_cont(o_totalprice, 0.75) as c from {gapped('orders')}) select o_orderkey, case when o_totalprice <= a then 'q1' when o_totalprice <= b then 'q2' when o_totalprice <= c then 'q3' when o_totalprice is not null then 'q4' end as quarter from {gapped('orders')}, q", True)
_FORMS = {"year": "strftime(o_orderdate, '%Y')", "quarter": "'Q' || quarter(o_orderdate)", "month": "strftime(o_orderdate, '%m')", "week": "strftime(o_orderdate, '%V')", "weekday": "strftime(o_orderdate, '%A')", "date": "cast(date_trunc('day', o_orderdate) as timestamp)", "hour": "strftime(o_orderdate, '%H')", "year_month": "strftime(o_orderdate, '%Y-%m')", "year_week": "strftime(o_orderdate, '%G-W%V')", "year_quarter": "strftime(o_orderdate, '%Y') || '-Q' || quarter(o_orderdate)"}
for _part in PARTS:
    recipe(f"date_part_{_part}", "orders", [{"op": "derive_column", "name": "part", "expression": {"kind": "datetime_part", "column": "o_orderdate", "part": _part}}, {"op": "select_columns", "columns": ["o_orderkey", "part"]}], f"select o_orderkey, {_FORMS[_part]} as part from orders")
recipe("map_values", "orders", [{"op": "derive_column", "name": "state", "expression": {"kind": "map_values", "column": "o_orderstatus", "mapping": {"F": "finished", "O": "open"}}}, {"op": "select_columns", "columns": ["o_orderkey", "state"]}], "select o_orderkey, case o_orderstatus when 'F' then 'finished' when 'O' then 'open' else o_orderstatus end as state from orders")
recipe("map_values_default", "orders", [{"op": "derive_column", "name": "state", "expression": {"kind": "map_values", "column": "o_orderpriority", "mapping": {"1-URGENT": "now"}, "default": "later"}}, {"op": "select_columns", "columns": ["o_orderkey", "state"]}], f"select o_orderkey, case when o_orderpriority is null then null when o_orderpriority = '1-URGENT' then 'now' else 'later' end as state from {gapped('orders')}", True)

_ALL = [{"function": f, "column": "l_quantity"} for f in ("sum", "mean", "median", "min", "max", "count")] + [{"function": "count"}]
_MADE = "round(sum_l_quantity, 4) as sum_l_quantity; round(mean_l_quantity, 6) as mean_l_quantity; median_l_quantity; min_l_quantity; max_l_quantity; count_l_quantity; row_count"
_ALL_SQL = "round(coalesce(sum(l_quantity), 0), 4) as sum_l_quantity, round(avg(l_quantity), 6) as mean_l_quantity, quantile_cont(l_quantity, 0.5) as median_l_quantity, min(l_quantity) as min_l_quantity, max(l_quantity) as max_l_quantity, count(l_quantity) as count_l_quantity, count(*) as row_count"
recipe("aggregate_one_key", "lineitem", [{"op": "aggregate", "group_by": ["l_returnflag"], "aggregations": _ALL}], f"select l_returnflag, {_ALL_SQL} from {gapped('lineitem')} group by 1", True, f"l_returnflag; {_MADE}")
recipe("aggregate_two_keys", "lineitem", [{"op": "aggregate", "group_by": ["l_returnflag", "l_linestatus"], "aggregations": _ALL}], f"select l_returnflag, l_linestatus, {_ALL_SQL} from {gapped('lineitem')} group by 1, 2", True, f"l_returnflag; l_linestatus; {_MADE}")
recipe("aggregate_whole", "lineitem", [{"op": "aggregate", "aggregations": _ALL}], f"select {_ALL_SQL} from {gapped('lineitem')}", True, _MADE)
recipe("aggregate_gap_keys", "events", [{"op": "aggregate", "group_by": ["event_type"], "aggregations": [{"function": "sum", "column": "value"}, {"function": "count"}]}], f"select event_type, round(sum(value), 4) as sum_value, count(*) as row_count from {gapped('events')} where event_type is not null group by 1", True, "event_type; round(sum_value, 4) as sum_value; row_count")


@register("flagship", "select l_returnflag, round(sum(l_extendedprice), 2) as total from lineitem where l_quantity > 10 group by 1")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profiled table through a recipe: filter, aggregate, sort."""
    table = load(spark, sf_dir, "lineitem")
    out = steps(table, {"op": "filter_rows", "clauses": [{"column": "l_quantity", "operator": "gt", "value": 10}]}, _SUM, {"op": "sort_rows", "columns": ["total"], "order": "desc"})
    return out.ordered().selectExpr("l_returnflag", "round(total, 2) as total")


_CUSTOMER = {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"}


@register("profile_columns", " union all ".join(f"select '{n}' as name, '{t}' as dtype, count(*) - count({n}) as n_missing, count(distinct {n}) as n_unique from customer" for n, t in _CUSTOMER.items()))
def profile_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile_frame(read_parquet(spark, f"{sf_dir}/customer.parquet")).select("name", "dtype", "n_missing", "n_unique")


@register("sort_nulls_last", f"select o_orderpriority, count(*) as n, cast(row_number() over (order by o_orderpriority desc nulls last) as int) as place, true as together from {gapped('orders')} group by 1")
def sort_nulls_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each priority stands when all rows are sorted by it downwards, and whether its rows are together."""
    table = steps(load(spark, sf_dir, "orders", True), {"op": "sort_rows", "columns": ["o_orderpriority"], "order": "desc"})
    placed = table.ordered().select("o_orderpriority", F.monotonically_increasing_id().alias("at"))
    groups = placed.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.max("at").alias("last"))
    by_place = Window.orderBy("first")  # a row for each priority
    return groups.select("o_orderpriority", "n", F.row_number().over(by_place).alias("place"), (F.coalesce(F.lag("last").over(by_place), F.lit(-1)) < F.col("first")).alias("together"))


_KINDS = {"o_orderkey": ("bigint", "numeric"), "o_custkey": ("bigint", "numeric"), "o_orderstatus": ("string", "categorical"), "o_totalprice": ("double", "numeric"), "o_orderdate": ("timestamp_ntz", "datetime"), "o_orderpriority": ("string", "categorical")}


@register("profile_kinds", " union all ".join(
    f"""select '{n}' as name, '{dtype}' as dtype, '{kind}' as kind, cast(count(*) - count(x) as bigint) as n_missing, 1 - count(x) / count(*) as missing_ratio, count(distinct x) as n_unique,
  {"count(distinct x) >= 0.99 * count(*)" if kind == "categorical" else "false"} as is_id, count(distinct x) <= 1 as is_constant, {"count(distinct x) > 50" if kind == "categorical" else "false"} as is_wide,
  (select list(v order by spot) from (select cast({n} as varchar) as v, min(spot) as spot from (select {n}, row_number() over () as spot from orders) where {n} is not null group by 1 order by 2 limit 3)) as samples
  from (select {n} as x from orders)""" for n, (dtype, kind) in _KINDS.items()
))
def profile_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile_frame(read_parquet(spark, f"{sf_dir}/orders.parquet"))


@register("duplicate_rows", f"select cast(count(*) - (select count(*) from (select distinct event_type, value from {gapped('events')})) as bigint) as n from {gapped('events')}")
def duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = steps(load(spark, sf_dir, "events", True), {"op": "select_columns", "columns": ["event_type", "value"]})
    return spark.createDataFrame([(int(duplicate_rows(table)),)], "n bigint")


@register("distinct_values", "select 'l_returnflag' as name, l_returnflag as value, count(*) as n from lineitem group by all union all select 'l_linestatus', l_linestatus, count(*) from lineitem group by all")
def distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return value_counts(load(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"]).select("name", "value", "n")


_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount")
_SUMMARY = "count(x) as count, cast(count(*) - count(x) as bigint) as missing, round(avg(x), 4) as mean, round(quantile_cont(x, 0.5), 4) as median, round(stddev_samp(x), 4) as std, min(x) as min, max(x) as max, round(quantile_cont(x, 0.25), 4) as q1, round(quantile_cont(x, 0.75), 4) as q3, round(skewness(x), 4) as skewness"


@register("numeric_summary", " union all ".join(f"select '{n}' as name, {_SUMMARY} from (select {n} as x from {gapped('lineitem')})" for n in _NUMBERS))
def numeric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounded = lambda c: F.round(c, 4).alias(c)
    told = stats.moments_frame(load(spark, sf_dir, "lineitem", True), list(_NUMBERS))
    return told.select("name", "count", "missing", rounded("mean"), rounded("median"), rounded("std"), "min", "max", rounded("q1"), rounded("q3"), rounded("skewness"))


@register("histogram", f"""with b as (select min(l_quantity) as lo, max(l_quantity) as hi, least(30, count(distinct l_quantity)) as n from {gapped('lineitem')})
select cast(least(floor((l_quantity - lo) / ((hi - lo) / n)), n - 1) as int) as bin, count(*) as n from {gapped('lineitem')}, b where l_quantity is not null group by 1""")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = load(spark, sf_dir, "lineitem", True)
    r = stats.moments_frame(table, ["l_quantity"]).first()
    bins = stats.bucket(num(col("l_quantity"), table.kind("l_quantity")), stats.bucket_edges(r["min"], r["max"], r["unique"]))
    return table.frame.groupBy(bins.alias("bin")).agg(F.count("*").alias("n")).filter("bin is not null")


@register("iqr_outliers", "with q as (select quantile_cont(o_totalprice, 0.25) as a, quantile_cont(o_totalprice, 0.75) as b from orders) select count(*) as n from orders, q where o_totalprice < a - 1.5 * (b - a) or o_totalprice > b + 1.5 * (b - a)")
def iqr_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = load(spark, sf_dir, "orders")
    r = stats.moments_frame(table, ["o_totalprice"]).first()
    low, high = stats.fences(r["q1"], r["q3"])
    return table.frame.filter((F.col("o_totalprice") < low) | (F.col("o_totalprice") > high)).agg(F.count("*").alias("n"))


@register("category_frequencies", f"""with c as (select o_orderpriority as value, count(*) as n from {gapped('orders')} where o_orderpriority is not null group by 1)
select value, n, round(n / (select sum(n) from c), 6) as share from c order by n desc, value limit 10""")
def category_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = stats.frequencies(load(spark, sf_dir, "orders", True), ["o_orderpriority"])[0]
    return spark.createDataFrame([(v, n, round(s, 6)) for v, n, s in told.top], "value string, n bigint, share double")


_RANK = "rank() over (order by {0}) + (count(*) over (partition by {0}) - 1) / 2.0"
_PAIRS = [("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_discount")]


@register("correlation_pairs", " union all ".join(
    f"select '{a}' as \"left\", '{b}' as \"right\", count(*) as n, round(corr({a}, {b}), 6) as pearson, round(corr(ra, rb), 6) as spearman from (select {a}, {b}, {_RANK.format(a)} as ra, {_RANK.format(b)} as rb from {gapped('lineitem')} where {a} is not null and {b} is not null)"
    for a, b in _PAIRS
))
def correlation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.correlate(load(spark, sf_dir, "lineitem", True), list(_NUMBERS))
    return spark.createDataFrame([(c.left, c.right, c.n, round(c.pearson, 6), round(c.spearman, 6)) for c in found], "left string, right string, n bigint, pearson double, spearman double")


@register("group_comparison", """with g as (select o_orderpriority as g, count(*) as n, avg(o_totalprice) as mean, quantile_cont(o_totalprice, 0.25) as q1, quantile_cont(o_totalprice, 0.5) as median, quantile_cont(o_totalprice, 0.75) as q3, coalesce(stddev_samp(o_totalprice), 0) as std, min(o_totalprice) as min, max(o_totalprice) as max from orders group by 1 having count(*) >= 5)
select g, any_value(n) as n, round(any_value(mean), 4) as mean, round(any_value(median), 4) as median, round(any_value(std), 4) as std, any_value(min) as min, any_value(max) as max, round(any_value(q1), 4) as q1, round(any_value(q3), 4) as q3,
  min(o_totalprice) filter (o_totalprice >= q1 - 1.5 * (q3 - q1)) as low, max(o_totalprice) filter (o_totalprice <= q3 + 1.5 * (q3 - q1)) as high from orders join g on o_orderpriority = g group by g""")
def group_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = Written(spark, "group_comparison")
    told = stats.group_stats(stats.group_counts(load(spark, sf_dir, "orders"), [("o_orderpriority", "o_totalprice")], kept), kept)
    return told.select("g", "n", *(F.round(c, 4).alias(c) for c in ("mean", "median", "std")), "min", "max", *(F.round(c, 4).alias(c) for c in ("q1", "q3")), "low", "high")


@register("kruskal", f"""with r as (select l_returnflag as g, {_RANK.format('l_quantity')} as r from lineitem), s as (select g, count(*) as n, sum(r) as s from r group by g),
t as (select sum(pow(c, 3) - c) as t from (select count(*)::double as c from lineitem group by l_quantity)), n as (select count(*)::double as n from lineitem)
select round((12 / (any_value(n.n) * (any_value(n.n) + 1)) * sum(s * s / s.n) - 3 * (any_value(n.n) + 1)) / (1 - any_value(t) / (pow(any_value(n.n), 3) - any_value(n.n))), 4) as h from s, t, n""")
def kruskal(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Written(spark, "kruskal") as kept:
        h, _, _ = stats.kruskal(stats.group_counts(load(spark, sf_dir, "lineitem"), [("l_returnflag", "l_quantity")], kept), kept)[0]
    return spark.createDataFrame([(round(h, 4),)], "h double")


def _periods(table: str, time: str, value: str, rule: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = timeline.time_rows(load(spark, sf_dir, table, True), time, [value])
        return timeline.resampled(rows, rule).select("period", F.round("value", 7).alias("value"))

    return query


for _rule, _table, _time, _value, _unit, _label in (("D", "events", "ts", "value", "day", "p"), ("W", "orders", "o_orderdate", "o_totalprice", "week", "p + interval 6 day"), ("MS", "orders", "o_orderdate", "o_totalprice", "month", "p")):
    _name = {"D": "timeline_daily", "W": "timeline_weekly", "MS": "timeline_monthly"}[_rule]
    register(_name, f"""with m as (select date_trunc('{_unit}', {_time})::timestamp as p, avg({_value}) as v from {gapped(_table)} where {_value} is not null group by 1),
s as (select unnest(generate_series(min(p), max(p), interval 1 {_unit})) as p from m) select {_label} as period, round(v, 7) as value from s left join m using (p)""")(_periods(_table, _time, _value, _rule))


@register("trend_slope", """with d as (select date_trunc('day', ts) as p, avg(value) as v from events group by 1), n as (select v, row_number() over (order by p) - 1 as i, count(*) over () as n from d)
select round(avg(v) filter (i < greatest(1, n // 4)), 4) as first, round(avg(v) filter (i >= n - greatest(1, n // 4)), 4) as last, round(regr_slope(v, i), 5) as slope from n""")
def trend_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = timeline.timeline(load(spark, sf_dir, "events"), "ts", "value")
    values = [v for _, v in found.points if v is not None]
    width = max(1, len(values) // 4)
    return spark.createDataFrame([(round(sum(values[:width]) / width, 4), round(sum(values[-width:]) / width, 4), round(found.slope, 5))], "first double, last double, slope double")


@register("largest_change", """with d as (select date_trunc('day', ts)::timestamp as p, avg(value) as v from events group by 1), c as (select p, v - lag(v) over (order by p) as change from d)
select p as period, round(change, 4) as change from c where change is not null order by abs(change) desc, p limit 1""")
def largest_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = timeline.timeline(load(spark, sf_dir, "events"), "ts", "value").largest
    return spark.createDataFrame([(found.after, round(found.difference, 4))], "period timestamp_ntz, change double")


@register("seasonality", """with d as (select date_trunc('day', ts) as p, avg(value) as v from events group by 1), g as (select strftime(p, '%A') as g, count(*) as n, avg(v) as m from d group by 1)
select round((select sum(n * pow(m - (select avg(v) from d), 2)) from g) / sum(pow(v - (select avg(v) from d), 2)), 5) as strength from d""")
def seasonality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = timeline.timeline(load(spark, sf_dir, "events"), "ts", "value").season
    return spark.createDataFrame([(round(found.strength, 5),)], "strength double")


@register("dashboard")
def dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score, issues, findings and charts of the orders, as rows of kind, name, detail and value."""
    from .operators.dashboard import look

    found = look(read_parquet(spark, f"{sf_dir}/orders.parquet"))
    rows = [("score", "quality", "", float(found.quality.score))]
    rows += [("dimension", d.name, "", float(-1 if d.score is None else d.score)) for d in found.quality.dimensions]
    rows += [("issue", i.kind, i.column or "", float(i.ratio)) for i in found.quality.issues]
    rows += [("insight", i.kind, i.title, float(i.importance)) for i in found.insights]
    rows += [("chart", c.kind, ",".join(c.columns), float(len(c.data))) for c in found.charts]
    return spark.createDataFrame(rows, "kind string, name string, detail string, value double")


from . import look_queries  # noqa: E402, F401  (adds the queries of the first look)

__all__ = ["ORACLE_SQL", "QUERIES", "load", "moment", "of_frame", "understood"]
