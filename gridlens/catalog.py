"""Queries over the driver's tables, one or more for each group of operators, and the same in SQL.

Grids: ``lineitem`` as cells (row = order key, column = line number, borders from the flags) on sheets of 500 orders, and
``events`` as cells (row = day and hour, column = minute) for layout.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import export
from .functions import address, coerce, formats, markdown
from .functions.library import register_sql
from .operators import grid, layout, lookups, shapes
from .plans import evaluate
from .plans.compile import aggregate, column, project, where

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql.strip()
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *names: str, digits: int = 2) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n).cast("double"), digits) for n in names})


def counts(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("bigint") for n in names})


# ---------------------------------------------------------------- aggregates


@query("select l_linestatus, round(sum(case when l_quantity > 25 and l_returnflag = 'R' then l_extendedprice else 0 end), 2) as total from lineitem group by l_linestatus")
def agg_sumifs(spark, sf_dir):
    return rounded(aggregate(table(spark, sf_dir, "lineitem"), ["l_linestatus"], total='=SUMIFS([l_extendedprice],[l_quantity],">25",[l_returnflag],"R")'), "total")


@query("select l_returnflag, round(sum(case when l_discount >= 0.05 then l_extendedprice else 0 end), 2) as total, round(sum(case when l_quantity < 10 then l_quantity else 0 end), 2) as small from lineitem group by l_returnflag")
def agg_sumif(spark, sf_dir):
    return rounded(aggregate(table(spark, sf_dir, "lineitem"), ["l_returnflag"], total='=SUMIF([l_discount],">=0.05",[l_extendedprice])', small='=SUMIF([l_quantity],"<10")'), "total", "small")


@query("select o_orderstatus, count(*) filter (where o_totalprice > 100000)::bigint as large, count(*) filter (where o_orderpriority = '1-URGENT')::bigint as urgent, count(*) filter (where o_orderpriority <> '5-LOW')::bigint as not_low from orders group by o_orderstatus")
def agg_countif(spark, sf_dir):
    out = aggregate(table(spark, sf_dir, "orders"), ["o_orderstatus"], large='=COUNTIF([o_totalprice],">100000")', urgent='=COUNTIF([o_orderpriority],"1-URGENT")', not_low='=COUNTIF([o_orderpriority],"<>5-LOW")')
    return counts(out, "large", "urgent", "not_low")


@query("select l_linestatus, count(*) filter (where l_quantity >= 10 and l_quantity <= 20 and l_returnflag = 'A')::bigint as n from lineitem group by l_linestatus")
def agg_countifs(spark, sf_dir):
    return counts(aggregate(table(spark, sf_dir, "lineitem"), ["l_linestatus"], n='=COUNTIFS([l_quantity],">=10",[l_quantity],"<=20",[l_returnflag],"A")'), "n")


@query("select o_orderpriority, round(avg(case when o_orderstatus = 'F' then o_totalprice end), 2) as mean from orders group by o_orderpriority")
def agg_averageif(spark, sf_dir):
    return rounded(aggregate(table(spark, sf_dir, "orders"), ["o_orderpriority"], mean='=AVERAGEIF([o_orderstatus],"F",[o_totalprice])'), "mean")


@query("select l_returnflag, round(avg(case when l_quantity > 25 and l_linestatus = 'O' then l_extendedprice end), 2) as mean, '#DIV/0!' as nothing from lineitem group by l_returnflag")
def agg_averageifs(spark, sf_dir):
    out = aggregate(table(spark, sf_dir, "lineitem"), ["l_returnflag"], mean='=AVERAGEIFS([l_extendedprice],[l_quantity],">25",[l_linestatus],"O")', nothing='=AVERAGEIFS([l_extendedprice],[l_quantity],"<0")')
    return rounded(out, "mean")


@query("select o_orderstatus, round(sum(o_totalprice), 2) as total, min(o_totalprice) as low, max(o_totalprice) as high, round(avg(o_totalprice), 2) as mean, count(o_totalprice)::bigint as numbers, count(o_orderpriority)::bigint as filled, 0::bigint as words from orders group by o_orderstatus")
def agg_basic(spark, sf_dir):
    out = aggregate(table(spark, sf_dir, "orders"), ["o_orderstatus"], total="=SUM([o_totalprice])", low="=MIN([o_totalprice])", high="=MAX([o_totalprice])", mean="=AVERAGE([o_totalprice])", numbers="=COUNT([o_totalprice])", filled="=COUNTA([o_orderpriority])", words="=COUNT([o_orderpriority])")
    return counts(rounded(out, "total", "mean"), "numbers", "filled", "words")


@query("select l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem group by l_returnflag")
def agg_sumproduct(spark, sf_dir):
    return rounded(aggregate(table(spark, sf_dir, "lineitem"), ["l_returnflag"], revenue="=SUMPRODUCT([l_extendedprice],1-[l_discount])"), "revenue")


@query("select p_type, round(avg(p_retailprice), 2) as c1, max(p_retailprice) as c4, min(p_size)::double as c5, round(sum(p_retailprice), 2) as c109 from part group by p_type")
def agg_subtotal(spark, sf_dir):
    out = aggregate(table(spark, sf_dir, "part"), ["p_type"], c1="=SUBTOTAL(1,[p_retailprice])", c4="=SUBTOTAL(4,[p_retailprice])", c5="=SUBTOTAL(5,[p_size])", c109="=SUBTOTAL(109,[p_retailprice])")
    return rounded(out, "c1", "c109")


@query("select event_type, count(*)::bigint as texts_as_zero, 0::bigint as above, count(*)::bigint as equals_blank, count(*)::bigint as any_text, round(sum(value), 2) as total from events group by event_type")
def criteria_coercion(spark, sf_dir):
    """Texts count as 0 against a number, and an operator alone compares with 0."""
    out = aggregate(table(spark, sf_dir, "events"), ["event_type"], texts_as_zero='=COUNTIF([props],"<5")', above='=COUNTIF([props],">5")', equals_blank='=COUNTIF([props],"=")', any_text='=COUNTIF([props],"<>zzz")', total='=SUMIF([props],"<=0",[value])')
    return rounded(counts(out, "texts_as_zero", "above", "equals_blank", "any_text"), "total")


@query("select o_orderkey, bool_and(l_quantity > 2) as every, bool_or(l_discount > 0.09) as any_deep from lineitem join orders on l_orderkey = o_orderkey group by o_orderkey")
def agg_and_or(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    lines = project(lines, a="=AND([l_quantity]>2)", b="=OR([l_discount]>0.09)")
    return lines.groupBy("o_orderkey").agg(F.bool_and("a").alias("every"), F.bool_or("b").alias("any_deep"))


# ---------------------------------------------------------------- lookups

TIERS = [(1, 0.0, "bronze"), (2, 100000.0, "silver"), (3, 50000.0, "copper"), (4, 300000.0, "gold"), (5, 200000.0, "late")]
_TIERS_SQL = ", ".join(f"({p}, {k}::double, '{v}')" for p, k, v in TIERS)


def tiers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TIERS, "pos int, k double, v string")


def _step_sql(test: str, pick: str) -> str:
    return f"""with t(pos, k, v) as (values {_TIERS_SQL})
    select o_orderkey, coalesce(min(v) filter (where pos = e), min(v) filter (where pos = a), '#N/A') as tier from (
      select o.o_orderkey, t.pos, t.v, min(case when t.k = o.o_totalprice then t.pos end) over (partition by o.o_orderkey) as e,
        {pick}(case when t.k {test} o.o_totalprice then t.pos end) over (partition by o.o_orderkey) as a from orders o cross join t) group by o_orderkey"""


@query("select o_orderkey, coalesce(c_mktsegment, '#N/A') as segment from orders left join customer on o_custkey = c_custkey")
def lookup_vlookup_exact(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return lookups.exact(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("o_custkey"), customers, "c_custkey", "c_mktsegment", "segment", "c_custkey").select("o_orderkey", "segment")


@query(_step_sql("<=", "max"))
def lookup_vlookup_approx(spark, sf_dir):
    """An unsorted table of steps: the last position with a key not above, exact hits first."""
    orders = table(spark, sf_dir, "orders")
    return lookups.approximate(orders, F.col("o_totalprice"), tiers(spark), "k", "v", "tier").select("o_orderkey", "tier")


@query("select o_orderkey, case o_orderstatus when 'F' then 'done' when 'O' then 'open' else '#N/A' end as label from orders")
def lookup_hlookup(spark, sf_dir):
    row = spark.createDataFrame([("done", "open")], "f string, o string")
    across = lookups.horizontal(row, {"f": "F", "o": "O"}, {"f": "f", "o": "o"})
    return lookups.exact(table(spark, sf_dir, "orders"), F.col("o_orderstatus"), across, "key", "result", "label").select("o_orderkey", "label")


def _brands(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name")


@query("select distinct 'Brand#' || i as brand, coalesce((select arg_min(p_name, p_partkey) from part where p_brand = 'Brand#' || i), 'none') as name from range(1, 31) r(i)")
def lookup_xlookup_first(spark, sf_dir):
    asked = spark.range(1, 31).select(F.concat(F.lit("Brand#"), F.col("id")).alias("brand"))
    return lookups.exact(asked, F.col("brand"), _brands(spark, sf_dir), "p_brand", "p_name", "name", "p_partkey", missing="none")


@query("select distinct 'Brand#' || i as brand, coalesce((select arg_max(p_name, p_partkey) from part where p_brand = 'Brand#' || i), 'none') as name from range(1, 31) r(i)")
def lookup_xlookup_last(spark, sf_dir):
    asked = spark.range(1, 31).select(F.concat(F.lit("Brand#"), F.col("id")).alias("brand"))
    return lookups.exact(asked, F.col("brand"), _brands(spark, sf_dir), "p_brand", "p_name", "name", "p_partkey", last=True, missing="none")


@query(_step_sql("<=", "max"))
def lookup_xlookup_next_smaller(spark, sf_dir):
    return lookups.approximate(table(spark, sf_dir, "orders"), F.col("o_totalprice"), tiers(spark), "k", "v", "tier", mode=-1).select("o_orderkey", "tier")


@query(_step_sql(">=", "min"))
def lookup_xlookup_next_larger(spark, sf_dir):
    return lookups.approximate(table(spark, sf_dir, "orders"), F.col("o_totalprice"), tiers(spark), "k", "v", "tier", mode=1).select("o_orderkey", "tier")


@query("""select p as pattern, coalesce(r, '#N/A') as result from (values ('*widget', (select arg_min(p_name, p_partkey) from part where p_name ilike '%widget')),
    ('RED ?ing', (select arg_min(p_name, p_partkey) from part where p_name ilike 'RED _ing')), ('no~*thing', null)) t(p, r)""")
def lookup_xlookup_wildcard(spark, sf_dir):
    return lookups.wildcard(_brands(spark, sf_dir), "p_name", "p_name", ["*widget", "RED ?ing", "no~*thing"], "p_partkey")


@query("""with recursive t as (select row_number() over (order by o_orderkey) - 1 as i, o_totalprice as k, o_orderkey as v from orders), n as (select count(*) as n from t),
    p as (select c_custkey, c_acctbal * 30 as x, 0::bigint as low, n - 1 as high, null::bigint as best, null::double as best_k, false as hit from customer, n
      union all select p.c_custkey, p.x, case when t.k <> p.x and t.k < p.x then t.i + 1 else p.low end, case when t.k <> p.x and t.k > p.x then t.i - 1 else p.high end,
        case when t.k = p.x or t.k < p.x and (p.best_k is null or t.k > p.best_k) then t.v else p.best end, case when t.k < p.x and (p.best_k is null or t.k > p.best_k) then t.k else p.best_k end, t.k = p.x
      from p join t on t.i = (p.low + p.high) // 2 where p.low <= p.high and not p.hit)
    select c_custkey, coalesce(arg_max(best, high - low < 0 or hit)::varchar, '#N/A') as step from (select *, row_number() over (partition by c_custkey order by high - low, hit desc) as last from p) where last = 1 group by c_custkey""")
def lookup_xlookup_binary(spark, sf_dir):
    """The probes of a binary search in an unsorted table, whatever they hit; next smaller."""
    orders = lookups.with_position(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")
    asked = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") * 30).alias("x"))
    return lookups.binary(asked, F.col("x"), orders, "o_totalprice", "o_orderkey", "step", match=-1, small=1000).select("c_custkey", "step")


_PRICES = "o as (select o_orderkey as pos, o_totalprice as k from orders), a as (select c_custkey, round(c_acctbal * 30, 2) as x from customer)"


@query(f"""with {_PRICES} select c_custkey, coalesce(coalesce((select min(pos) from o where k = x), (select max(pos) from o where k <= x))::varchar, '#N/A') as step from a""")
def lookup_vlookup_approx_large(spark, sf_dir):
    """An unsorted table that is too large for a literal."""
    return _by_price(spark, sf_dir, -1, False)


@query(f"""with {_PRICES} select c_custkey, coalesce(coalesce((select max(pos) from o where k = x), (select max(pos) from o where k >= x))::varchar, '#N/A') as step from a""")
def lookup_xlookup_next_larger_last(spark, sf_dir):
    return _by_price(spark, sf_dir, 1, True)


def _by_price(spark, sf_dir, mode, last):
    asked = table(spark, sf_dir, "customer").select("c_custkey", F.round(F.col("c_acctbal") * 30, 2).alias("x"))
    return lookups.approximate(asked, F.col("x"), table(spark, sf_dir, "orders"), "o_totalprice", "o_orderkey", "step", mode, last, "o_orderkey", small=1000).select("c_custkey", "step")


@query("select e.event_id, coalesce(arg_max(t.v, t.k), '#N/A') as band from events e left join (select i::double as k, 'b' || i as v from range(0, 200, 25) r(i)) t on t.k <= e.value group by e.event_id")
def lookup_sorted_asof(spark, sf_dir):
    """The same as one ordered pass over both sides, for tables of any size."""
    steps = spark.range(0, 200, 25).select(F.col("id").cast("double").alias("k"), F.concat(F.lit("b"), F.col("id")).alias("v"))
    asks = table(spark, sf_dir, "events").select("event_id", "value", F.col("event_type").alias("kind"))
    kinds = asks.select("kind").distinct()
    return lookups.sorted_asof(asks, "value", steps.crossJoin(F.broadcast(kinds)), "k", "v", "band", by=["kind"]).select("event_id", "band")


@query("""select s as size, coalesce(m::varchar, '#N/A') as at, (select p_name from part where p_partkey + 1 = m) as name
    from (select s, (select min(p_partkey + 1) from part where p_size = s) as m from range(1, 61) r(s))""")
def lookup_match_index(spark, sf_dir):
    part = table(spark, sf_dir, "part").select((F.col("p_partkey") + 1).alias("pos"), "p_size", "p_name")
    asked = spark.range(1, 61).select(F.col("id").alias("size"))
    at = lookups.match(asked, F.col("size"), part, "p_size", "at")
    return lookups.index(at, F.col("at").try_cast("bigint"), part, "p_name", "name")


# ---------------------------------------------------------------- functions


@query("""select o_orderkey, case when o_totalprice > 200000 and o_orderstatus = 'F' then 'big' else 'other' end as kind,
    not (o_orderstatus = 'O' or o_orderstatus = 'P') as closed from orders""")
def fn_logical(spark, sf_dir):
    return project(table(spark, sf_dir, "orders"), kind='=IF(AND([o_totalprice]>200000,[o_orderstatus]="F"),"big","other")', closed='=NOT(OR([o_orderstatus]="O",[o_orderstatus]="P"))').select("o_orderkey", "kind", "closed")


@query("select o_orderkey, case when strpos(o_orderpriority, 'URGENT') = 0 then 'none' else strpos(o_orderpriority, 'URGENT')::varchar end as at from orders")
def fn_iferror(spark, sf_dir):
    return project(table(spark, sf_dir, "orders"), at='=IFERROR(FIND("URGENT",[o_orderpriority]),"none")').select("o_orderkey", "at")


@query("select n_nationkey, case n_regionkey + 1 when 1 then 'a' when 2 then 'b' when 3 then 'c' end as letter from nation")
def fn_choose(spark, sf_dir):
    return project(table(spark, sf_dir, "nation"), letter='=CHOOSE([n_regionkey]+1,"a","b","c")').select("n_nationkey", "letter")


@query("""select c_custkey, length(c_name)::bigint as len, left(c_name, 4) as lft, right(c_name, 3) as rgt, substr(c_name, 3, 5) as mid, upper(c_name) as up, lower(c_mktsegment) as low,
    coalesce(nullif(strpos(c_name, '#'), 0)::varchar, '#VALUE!') as find, coalesce(nullif(strpos(lower(c_name), 'omer'), 0)::varchar, '#VALUE!') as search,
    'X' || substr(c_name, 4) as replaced, replace(c_name, '0', 'o') as subst, repeat(left(c_name, 1), 3) as rept, c_name || '/' || c_mktsegment as joined, regexp_replace(trim('  ' || c_name || '   x '), '\\s+', ' ', 'g') as trimmed from customer""")
def fn_text_basic(spark, sf_dir):
    out = project(
        table(spark, sf_dir, "customer"), len="=LEN([c_name])", lft="=LEFT([c_name],4)", rgt="=RIGHT([c_name],3)", mid="=MID([c_name],3,5)", up="=UPPER([c_name])", low="=LOWER([c_mktsegment])",
        find='=FIND("#",[c_name])', search='=SEARCH("OMER",[c_name])', replaced='=REPLACE([c_name],1,3,"X")', subst='=SUBSTITUTE([c_name],"0","o")', rept="=REPT(LEFT([c_name],1),3)",
        joined='=CONCATENATE([c_name],"/",[c_mktsegment])', trimmed='=TRIM("  "&[c_name]&"   x ")',
    )
    return counts(out, "len").drop("c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@query("select p_partkey, case when len(s) > 2 then array_to_string(s[1:2], 'e') || 'E' || array_to_string(s[3:], 'e') else p_name end as second_e from (select p_partkey, p_name, string_split(p_name, 'e') as s from part)")
def fn_substitute_nth(spark, sf_dir):
    return project(table(spark, sf_dir, "part"), second_e='=SUBSTITUTE([p_name],"e","E",2)').select("p_partkey", "second_e")


@query("""select c_custkey, floor(c_acctbal + 0.5) as r0, floor(c_acctbal * 10 + 0.5) / 10 as r1, floor(c_acctbal * 0.01 + 0.5) / 0.01 as rm2, case when c_acctbal >= 0 then ceil(c_acctbal) else floor(c_acctbal) end as up,
    case when c_acctbal >= 0 then floor(c_acctbal) else ceil(c_acctbal) end as down, floor(c_acctbal) as whole, abs(c_acctbal) as size from customer""")
def fn_round_family(spark, sf_dir):
    out = project(table(spark, sf_dir, "customer"), r0="=ROUND([c_acctbal],0)", r1="=ROUND([c_acctbal],1)", rm2="=ROUND([c_acctbal],-2)", up="=ROUNDUP([c_acctbal],0)", down="=ROUNDDOWN([c_acctbal],0)", whole="=INT([c_acctbal])", size="=ABS([c_acctbal])")
    return out.select("c_custkey", "r0", "r1", "rm2", "up", "down", "whole", "size")


_SERIAL = "date_diff('day', date '1899-12-30', {})::double"


@query(f"select o_orderkey, {_SERIAL.format('o_orderdate::date')} as serial, year(o_orderdate)::double as y, month(o_orderdate)::double as m, day(o_orderdate)::double as d, {_SERIAL.format('o_orderdate::date')} as again from orders")
def fn_date_parts(spark, sf_dir):
    return project(table(spark, sf_dir, "orders"), serial="=[o_orderdate]+0", y="=YEAR([o_orderdate])", m="=MONTH([o_orderdate])", d="=DAY([o_orderdate])", again="=DATE(YEAR([o_orderdate]),MONTH([o_orderdate]),DAY([o_orderdate]))").select("o_orderkey", "serial", "y", "m", "d", "again")


@query("select o_orderkey, (dayofweek(o_orderdate) + 1)::double as w1, isodow(o_orderdate)::double as w2, (isodow(o_orderdate) - 1)::double as w3 from orders")
def fn_weekday(spark, sf_dir):
    return project(table(spark, sf_dir, "orders"), w1="=WEEKDAY([o_orderdate])", w2="=WEEKDAY([o_orderdate],2)", w3="=WEEKDAY([o_orderdate],3)").select("o_orderkey", "w1", "w2", "w3")


@query(f"select o_orderkey, {_SERIAL.format('last_day(o_orderdate::date)')} as this, {_SERIAL.format('last_day((date_trunc(chr(109)||chr(111)||chr(110)||chr(116)||chr(104), o_orderdate) + interval 2 month)::date)')} as later from orders")
def fn_eomonth(spark, sf_dir):
    return project(table(spark, sf_dir, "orders"), this="=EOMONTH([o_orderdate],0)", later="=EOMONTH([o_orderdate],2)").select("o_orderkey", "this", "later")


@query("select o_orderkey, date_diff('day', date '1899-12-30', cast(date_trunc('month', o_orderdate) + interval 1 month as date) + cast(day(o_orderdate) - 1 as int))::double as next from orders")
def fn_edate_overflow(spark, sf_dir):
    return project(table(spark, sf_dir, "orders"), next="=EDATE([o_orderdate],1)").select("o_orderkey", "next")


@query(f"select o_orderkey, {_SERIAL.format('o_orderdate::date')} as slashes, {_SERIAL.format('o_orderdate::date')} as dashes, round(o_totalprice, 2) as price from orders")
def fn_datevalue_value(spark, sf_dir):
    out = project(table(spark, sf_dir, "orders"), slashes='=DATEVALUE(TEXT([o_orderdate],"yyyy/mm/dd"))', dashes='=VALUE(TEXT([o_orderdate],"yyyy-mm-dd"))', price='=VALUE(TEXT([o_totalprice],"#,##0.00"))')
    return out.select("o_orderkey", "slashes", "dashes", "price")


@query("""select o_orderkey, format('{:,.2f}', o_totalprice) as grouped, printf('%.2f', o_totalprice) as fixed, lpad(floor(o_totalprice / 1000)::bigint::varchar, greatest(4, length(floor(o_totalprice / 1000)::bigint::varchar))::int, '0') as padded,
    year(o_orderdate) || '/' || month(o_orderdate) || '/' || day(o_orderdate) as slashes, strftime(o_orderdate, '%Y-%m-%d') as dashes from orders""")
def fn_text_format(spark, sf_dir):
    out = project(table(spark, sf_dir, "orders"), grouped='=TEXT([o_totalprice],"#,##0.00")', fixed='=TEXT([o_totalprice],"0.00")', padded='=TEXT([o_totalprice]/1000,"0000")', slashes='=TEXT([o_orderdate],"yyyy/mm/dd")', dashes='=TEXT([o_orderdate],"yyyy-mm-dd")')
    return out.select("o_orderkey", "grouped", "fixed", "padded", "slashes", "dashes")


@query("""select event_id, event_type = 'click' as blank, event_type <> 'click' as txt, event_type = 'view' as num_of_text, value is not null as num, event_type = 'error' as na, event_type in ('error', 'purchase') as err from events""")
def fn_is_predicates(spark, sf_dir):
    out = project(
        table(spark, sf_dir, "events").withColumn("kind", F.when(F.col("event_type") == "view", "1,200").when(F.col("event_type") != "click", F.col("event_type")).otherwise("")),
        blank="=ISBLANK([kind])", num_of_text="=ISNUMBER([kind])", txt='=AND(ISTEXT([event_type]),NOT([kind]=""))', num="=ISNUMBER([value])",
        na='=ISNA(IF([event_type]="error",NA(),"x"))', err='=ISERROR(IF([event_type]="error","#N/A",IF([event_type]="purchase","#DIV/0!","#x")))',
    )
    return out.select("event_id", "blank", "num_of_text", "txt", "num", "na", "err")


@query("select o_orderkey, (o_orderkey % 3)::double as today from orders")
def fn_today(spark, sf_dir):
    return project(table(spark, sf_dir, "orders").withColumn("k", F.col("o_orderkey") % 3), today="=TODAY()-TODAY()+[k]").select("o_orderkey", "today")


@query("""select l_orderkey, l_linenumber, l_quantity / 3 * 100 as a, l_quantity || '|' || l_returnflag as b, l_quantity <= l_discount * 300 as c, -l_tax as d, l_quantity / 100 as pct,
    case when l_tax = 0 then 'Infinity' else 'finite' end as by_zero from (select *, l_quantity::bigint as q from lineitem)""".replace("l_quantity || '|'", "q || '|'"))
def fn_operators(spark, sf_dir):
    out = project(table(spark, sf_dir, "lineitem"), a="=[l_quantity]/3*100", b='=[l_quantity]&"|"&[l_returnflag]', c="=[l_quantity]<=[l_discount]*300", d="=-[l_tax]", pct="=[l_quantity]%", q="=1/[l_tax]")
    return out.select("l_orderkey", "l_linenumber", "a", "b", "c", "d", "pct", F.when(F.col("q") == float("inf"), "Infinity").otherwise("finite").alias("by_zero"))


@query("select o_orderkey, o_totalprice from orders where o_totalprice > 150000 and o_orderpriority <> '5-LOW'")
def fn_filter(spark, sf_dir):
    return where(table(spark, sf_dir, "orders"), '=AND([o_totalprice]>150000,[o_orderpriority]<>"5-LOW")').select("o_orderkey", "o_totalprice")


@query("select c_custkey, floor(c_acctbal * 10 + 0.5) / 10 as rounded, c_acctbal < 0 as wrong, left(c_name, 4) as lft from customer")
def fn_sql_functions(spark, sf_dir):
    """The functions that SQL text may call."""
    register_sql(spark)
    return table(spark, sf_dir, "customer").selectExpr("c_custkey", "xl_round(c_acctbal, 1) as rounded", "xl_is_error(if(c_acctbal < 0, '#VALUE!', '#CALC!')) as wrong", "xl_left(c_name, 4) as lft")


# ---------------------------------------------------------------- formats and addresses


@query("""select p_partkey, format('{:,.2f}', p_retailprice) as grouped, printf('%.2f', p_retailprice / 1000 * 100) || '%' as percent, strftime(date '1899-12-30' + p_size::int, '%Y-%m-%d') as iso,
    year(date '1899-12-30' + (p_size::int + 40000)) || '/' || month(date '1899-12-30' + (p_size::int + 40000)) || '/' || day(date '1899-12-30' + (p_size::int + 40000)) as slashes from part""")
def fmt_number(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("price", coerce.num_to_text(F.col("p_retailprice"))).withColumn("size", F.col("p_size").cast("string"))
    show = formats.display
    share = coerce.num_to_text(F.col("p_retailprice") / 1000)
    later = (F.col("p_size") + 40000).cast("string")
    return p.select("p_partkey", show(F.col("price"), "#,##0.00").alias("grouped"), show(share, "0.00%").alias("percent"), show(F.col("size"), "yyyy-mm-dd").alias("iso"), show(later, "yyyy/m/d").alias("slashes"))


@query("""select l_orderkey, l_linenumber, replace(printf('%.7e', l_extendedprice), 'e', 'E') as science, (l_quantity / 4 * 4)::bigint || '/1' as whole,
    case when l_tax = 0 then '-' else format('{:,.2f}', l_tax) end as zero from lineitem""")
def fmt_scientific(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    text = lambda c: coerce.num_to_text(F.col(c))
    return t.select("l_orderkey", "l_linenumber", formats.display(text("l_extendedprice"), "0.0000000E+00").alias("science"), formats.display(text("l_quantity"), "# ?/?", 12).alias("whole"), formats.display(text("l_tax"), '#,##0.00;-#,##0.00;"-"').alias("zero"))


@query("""select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as both, strftime(ts, '%H:%M:%S') as clock, month(ts) || '月' || day(ts) || '日' as short,
    case when year(ts) >= 2019 then '令和' || (year(ts) - 2018) when year(ts) >= 1989 then '平成' || (year(ts) - 1988) else year(ts)::varchar end || '年' || month(ts) || '月' || day(ts) || '日' as era,
    array_to_string(string_split(user_id::varchar, ''), ' ') as apart from (select event_id, date_trunc('second', ts) as ts, user_id from events)""")
def fmt_dates(spark, sf_dir):
    """Date codes without a way of their own, eras, and digits apart (format 186)."""
    e = table(spark, sf_dir, "events").withColumn("at", F.date_trunc("second", "ts"))
    serial = coerce.num_to_text(F.datediff("at", F.lit("1899-12-30").cast("date")) + (F.hour("at") * 3600 + F.minute("at") * 60 + F.second("at")) / 86400)
    show = lambda code: formats.display(serial, code)
    return e.select("event_id", show("m/d/yy h:mm").alias("both"), show("h:mm AM/PM").alias("clock"), show("m月d日").alias("short"), show("[$-411]ggge年m月d日").alias("era"), formats.display(F.col("user_id").cast("string"), "General", 186).alias("apart"))


@query("""select o_orderkey, case o_orderkey % 4 when 0 then format('{:,.2f}', o_totalprice) when 1 then printf('%.1f', o_totalprice * 100) || '%'
    when 2 then year(o_orderdate) || '/' || month(o_orderdate) || '/' || day(o_orderdate) else null end as shown from orders""")
def fmt_by_row(spark, sf_dir):
    """Codes from a column, read by distinct value."""
    k, price = F.col("o_orderkey") % 4, F.col("o_totalprice")
    code = F.when(k == 0, "#,##0.00").when(k == 1, "0.0%").when(k == 2, "yyyy/m/d").otherwise("General")
    raw = F.when(k == 2, F.datediff("o_orderdate", F.lit("1899-12-30").cast("date")).cast("string")).otherwise(coerce.num_to_text(price))
    return table(spark, sf_dir, "orders").select("o_orderkey", formats.display(raw, code, F.lit(0)).alias("shown"))


@query("""with n as (select p_partkey, p_partkey % 18278 + 1 as c from part), l as (select p_partkey, c,
    case when c <= 26 then chr((64 + c)::int) when c <= 702 then chr((64 + (c - 1) // 26)::int) || chr((65 + (c - 1) % 26)::int)
    else chr((64 + (c - 27) // 676)::int) || chr((65 + ((c - 27) // 26) % 26)::int) || chr((65 + (c - 1) % 26)::int) end as letters from n)
    select p_partkey, letters, c::bigint as back, letters || '7' as address from l""")
def addr_roundtrip(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("c", F.col("p_partkey") % 18278 + 1).withColumn("letters", address.letters_of(F.col("c")))
    return p.select("p_partkey", "letters", address.number_of(F.col("letters")).cast("bigint").alias("back"), address.address_of(F.lit(7), F.col("c")).alias("address"))


# ---------------------------------------------------------------- grid


SHEET_ROWS = 50


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as sheets of ``SHEET_ROWS`` orders: numbers, short words and blanks, some with borders."""
    t = table(spark, sf_dir, "lineitem")
    at = t.select(F.lit("lineitem").alias("workbook"), F.floor(F.col("l_orderkey") / SHEET_ROWS).cast("int").alias("sheet_index"), (F.col("l_orderkey") % SHEET_ROWS + 1).cast("int").alias("row"), F.col("l_linenumber").cast("int").alias("col"), "l_returnflag", "l_linestatus", "l_quantity", "l_tax")
    q = F.max("l_quantity")
    low, high = F.col("l_tax") < 0.035, F.col("l_tax") > 0.045
    flag = lambda c, v, also: F.bool_or((F.col(c) == v) & also)
    return at.groupBy("workbook", "sheet_index", "row", "col").agg(
        F.when(q > 20, coerce.num_to_text(q)).when(q < 12, F.concat(F.max("l_returnflag"), F.lit("-"), F.max("l_linestatus"))).otherwise("").alias("value"),
        flag("l_returnflag", "R", low).alias("top"), flag("l_linestatus", "F", low).alias("bottom"), flag("l_returnflag", "A", high).alias("left"), flag("l_linestatus", "O", high).alias("right"),
    )


def sheet_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged places on those sheets: two columns where a third line is large."""
    at = table(spark, sf_dir, "lineitem").where("l_linenumber = 3 and l_quantity > 44")
    row = (F.col("l_orderkey") % SHEET_ROWS + 1).cast("int")
    return at.select(F.lit("lineitem").alias("workbook"), F.floor(F.col("l_orderkey") / SHEET_ROWS).cast("int").alias("sheet_index"), row.alias("start_row"), F.lit(3).alias("start_col"), row.alias("end_row"), F.lit(4).alias("end_col"))


_CELLS = f"""cells as (select 'lineitem' as workbook, (l_orderkey // {SHEET_ROWS})::int as sheet_index, (l_orderkey % {SHEET_ROWS} + 1)::int as row, l_linenumber::int as col,
    case when max(l_quantity) > 20 then max(l_quantity)::bigint::varchar when max(l_quantity) < 12 then max(l_returnflag) || '-' || max(l_linestatus) else '' end as value, bool_or(l_returnflag = 'R' and l_tax < 0.035::double) as t, bool_or(l_linestatus = 'F' and l_tax < 0.035::double) as b,
    bool_or(l_returnflag = 'A' and l_tax > 0.045::double) as l, bool_or(l_linestatus = 'O' and l_tax > 0.045::double) as r from lineitem group by all)"""
_PLACES = """places as (select distinct sheet_index, row + dr as row, col + dc as col from cells, (values (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) d(dr, dc)
    where (dr = 0 and dc = 0) or (dr = 1 and true) or true),
    n as (select p.sheet_index, p.row, p.col, c.row is not null as present, coalesce(c.value, '') as value, coalesce(c.t, false) as t, coalesce(c.b, false) as b, coalesce(c.l, false) as l, coalesce(c.r, false) as r,
      coalesce(c.t, false) or coalesce(u.b, false) as nt, coalesce(c.b, false) or coalesce(d.t, false) as nb, coalesce(c.l, false) or coalesce(w.r, false) as nl, coalesce(c.r, false) or coalesce(e.l, false) as nr
      from places p left join cells c on c.sheet_index = p.sheet_index and c.row = p.row and c.col = p.col
      left join cells u on u.sheet_index = p.sheet_index and u.row = p.row - 1 and u.col = p.col left join cells d on d.sheet_index = p.sheet_index and d.row = p.row + 1 and d.col = p.col
      left join cells w on w.sheet_index = p.sheet_index and w.row = p.row and w.col = p.col - 1 left join cells e on e.sheet_index = p.sheet_index and e.row = p.row and e.col = p.col + 1)"""


@query(f"with {_CELLS}, {_PLACES} select sheet_index, row, col, nt as n_top, nb as n_bottom, nl as n_left, nr as n_right from n where present")
def grid_border_normalize(spark, sf_dir):
    return grid.normalized_borders(cells(spark, sf_dir)).where("present").select("sheet_index", "row", "col", "n_top", "n_bottom", "n_left", "n_right")


@query(f"""with {_CELLS}, {_PLACES} select sheet_index, row, (count(*) filter (where value <> ''))::bigint as non_empty, (count(*) filter (where nt or nb or nl or nr))::bigint as bordered,
    (count(*) filter (where t or b or l or r))::bigint as raw_bordered, (count(*) filter (where nt))::bigint as tops, (count(*) filter (where nb))::bigint as bottoms, max(length(value))::bigint as longest from n group by sheet_index, row""")
def grid_edge_stats(spark, sf_dir):
    return counts(grid.edge_stats(cells(spark, sf_dir)), "non_empty", "bordered", "raw_bordered", "tops", "bottoms", "longest").drop("workbook")


def _components_sql(name: str, seeds: str, joined: str) -> str:
    """Tables ``name``_l (seed and the least place of its component) by ``seeds`` and the condition ``joined`` of x and its
    right or lower neighbour y; box, cells and texts of each component in ``name``."""
    return f"""{name}_s as (select sheet_index as s, row, col, row * 1000 + col as pl, value, t, b, l, r from cells where {seeds}),
    {name}_h as (select x.s, x.pl as p, y.pl as q from {name}_s x join {name}_s y on x.s = y.s and (y.row = x.row and y.col = x.col + 1 or y.row = x.row + 1 and y.col = x.col) where {joined}),
    {name}_e as (select s, p, q from {name}_h union all select s, q, p from {name}_h),
    {name}_l(s, pl, label) using key (s, pl) as (select s, pl, pl from {name}_s union
      select e.s, e.q, min(n.label) from {name}_l n join {name}_e e on e.s = n.s and e.p = n.pl join recurring.{name}_l o on o.s = e.s and o.pl = e.q where n.label < o.label group by e.s, e.q),
    {name} as (select s, label, min(row) as r1, min(col) as c1, max(row) as r2, max(col) as c2, count(*) as members, count(*) filter (where value <> '') as texts, coalesce(sum(length(value)) filter (where value <> ''), 0) as letters
      from {name}_l join {name}_s using (s, pl) group by s, label)"""


def _candidates_sql(name: str, of: str, rejected: str) -> str:
    """Components as scored and trimmed candidates: s, label, box, score, reasons."""
    return f"""{name}_x as (select g.*, (r2 - r1 + 1) as nr, (c2 - c1 + 1) as nc, (r2 - r1 + 1) * (c2 - c1 + 1) as size, texts::double / ((r2 - r1 + 1) * (c2 - c1 + 1)) as density, greatest(2, ceil((c2 - c1 + 1) * 0.5::double)) as half,
      (select count(*) from {of}_l m join {of}_s v on v.s = m.s and v.pl = m.pl where m.s = g.s and m.label = g.label and v.row = g.r1 and length(v.value) between 1 and 24 and not regexp_full_match(v.value, '[0-9]+([.][0-9]+)?')) as header,
      (select count(*) from mg where mg.s = g.s and not (mg.r < g.r1 or mg.r > g.r2 or 4 < g.c1 or 3 > g.c2)) as merges,
      (select count(*) from n where n.sheet_index = g.s and n.row between g.r1 and g.r2 and n.col between g.c1 and g.c2 and (nt or nb or nl or nr)) as bordered from {of} g where r2 > r1 and c2 > c1),
    {name}_y as (select *, 2 + case when bordered >= greatest(2, ceil(members * 0.3::double)) then 3 else 0 end + case when density >= 0.55::double then 2 else 0 end + case when density >= 0.8::double then 1 else 0 end
        + case when header >= 2 then 2 else 0 end - case when merges >= greatest(2, ceil(size * 0.08::double)) then 1 else 0 end - case when letters / greatest(1, texts) > 36 and density < 0.7::double then 2 else 0 end as score,
      concat_ws('; ', 'At least 2x2 (+2)', case when bordered >= greatest(2, ceil(members * 0.3::double)) then 'Has borders (+3)' end, case when density >= 0.55::double then 'High density (+2)' end, case when density >= 0.8::double then 'Very high density (+1)' end,
        case when header >= 2 then 'Header-like first row (+2)' end, case when merges >= greatest(2, ceil(size * 0.08::double)) then 'Many merged cells (-1)' end, case when letters / greatest(1, texts) > 36 and density < 0.7::double then 'Mostly long prose (-2)' end) as reasons
      from {name}_x where not (merges >= 2 and density < 0.25::double and ({rejected}))),
    {name}_r as (select y.s, y.label, y.r1, y.r2, y.half, q.r, (select count(*) filter (where value <> '') from n where n.sheet_index = y.s and n.row = q.r and n.col between y.c1 and y.c2) as filled,
        coalesce((select max(length(value)) from n where n.sheet_index = y.s and n.row = q.r and n.col between y.c1 and y.c2), 0) as longest, (select count(*) from n where n.sheet_index = y.s and n.row = q.r and n.col between y.c1 and y.c2 and (nt or nb or nl or nr)) as lined,
        (select count(*) from n where n.sheet_index = y.s and n.row = q.r and n.col between y.c1 and y.c2 and (t or b or l or r)) as raw, (select count(*) from n where n.sheet_index = y.s and n.row = q.r and n.col between y.c1 and y.c2 and nt) as tops,
        (select count(*) from n where n.sheet_index = y.s and n.row = q.r and n.col between y.c1 and y.c2 and nb) as bottoms from {name}_y y, unnest(range(y.r1, y.r2 + 1)) q(r) where y.score >= 4),
    {name}_t as (select *, r < r2 and filled <= 2 and raw = 0 and lead(lined) over o >= half and lead(filled) over o >= half as title, raw = 0 and filled <= 1 as bare,
      lag(lined) over o >= half or lag(bottoms) over o >= half or tops >= half as under, longest >= 12 and lag(filled) over o >= half as note from {name}_r window o as (partition by s, label order by r)),
    {name}_u as (select *, min(r) filter (where not title) over (partition by s, label) as top from {name}_t),
    {name}_v as (select *, coalesce(min(r) filter (where r > top and under and bare) over (partition by s, label) - 1, r2) as low from {name}_u),
    {name}_w as (select s, label, min(top) as top, max(r) filter (where r between top and low and (r = top or not (bare and (under or note)))) as low from {name}_v group by s, label),
    {name} as (select y.s, y.label, w.top as r1, y.c1, w.low as r2, y.c2, y.score, y.reasons, (w.low - w.top + 1) * (y.c2 - y.c1 + 1) as area from {name}_y y join {name}_w w using (s, label))"""


def _tables_sql(mode: str) -> str:
    """Table detection: components, candidates, the second pass where the first found little, and pruning."""
    line = "(y.row = x.row and (x.t and y.t or x.b and y.b or x.r and y.l) or y.row > x.row and (x.l and y.l or x.r and y.r or x.b and y.t))"
    box = "{'r1': r1, 'c1': c1, 'r2': r2, 'c2': c2, 'score': score, 'reasons': reasons, 'area': area}"
    parts = [_CELLS, _PLACES, f"mg as (select (l_orderkey // {SHEET_ROWS})::int as s, (l_orderkey % {SHEET_ROWS} + 1)::int as r from lineitem where l_linenumber = 3 and l_quantity > 44)"]
    parts += [_components_sql("g", "t or b or l or r", line if mode == "border" else "true"), _candidates_sql("k", "g", "header < 2")]
    parts.append("first as (select * from (select *, row_number() over (partition by s, r1, c1, r2, c2 order by label) as nth from k) where nth = 1)")
    if mode == "border":
        parts.append(f"found as (select s, list({box}) as xs from first group by s)")
    else:
        parts += [_components_sql("h", "t or b or l or r or value <> ''", "true"), _candidates_sql("j", "h", "nr <= 6 and nc >= 10")]
        parts.append(f"""h_order as (select h.s, h.label, row_number() over (partition by h.s order by h.label) as i, h.r1, h.c1, h.r2, h.c2, (h.r2 - h.r1 + 1) * (h.c2 - h.c1 + 1) as area, k.x
      from h left join (select s, label, {box} as x from j) k on k.s = h.s and k.label = h.label),
    steps(s, i, xs) as (select h.s, 0::bigint, coalesce((select list({box}) from first f where f.s = h.s), []) from (select distinct s from h) h union all
      select s, i, case when x is null or many or len(list_filter(xs, lambda y: y.r1 = x.r1 and y.c1 = x.c1 and y.r2 = x.r2 and y.c2 = x.c2)) > 0 then xs else list_append(xs, x) end from (
        select st.s, o.i, st.xs, o.x, len(list_filter(ins, lambda a: a >= o.area * 0.4::double)) > 0 or len(ins) >= 2 and list_sum(ins) >= o.area * 0.6::double as many
        from (select st.*, o2.i as next, list_transform(list_filter(st.xs, lambda y: y.r1 >= o2.r1 and y.c1 >= o2.c1 and y.r2 <= o2.r2 and y.c2 <= o2.c2), lambda y: y.area) as ins from steps st join h_order o2 on o2.s = st.s and o2.i = st.i + 1) st join h_order o on o.s = st.s and o.i = st.next)),
    found as (select s, arg_max(xs, i) as xs from steps group by s)""")
    parts.append("listed as (select s, unnest(xs) as x, xs from found)")
    parts.append("""sifted as (select s, x, list_transform(list_filter(xs, lambda y: y.r1 >= x.r1 and y.c1 >= x.c1 and y.r2 <= x.r2 and y.c2 <= x.c2 and y.area < x.area), lambda y: y.area) as less from listed)""")
    return "with recursive " + ",\n    ".join(parts) + """
    select 'lineitem' as workbook, s as sheet_index, x.r1::int as start_row, x.c1::int as start_col, x.r2::int as end_row, x.c2::int as end_col, x.score::int as score, x.reasons as reasons
    from sifted where len(list_filter(less, lambda a: a >= x.area * 0.4::double)) = 0 and not (len(less) >= 2 and list_sum(less) >= x.area * 0.6::double)"""


@query(_tables_sql("balanced"))
def grid_table_candidates(spark, sf_dir):
    found = grid.detect_tables(cells(spark, sf_dir), sheet_merges(spark, sf_dir))
    return found.withColumn("reasons", F.array_join("reasons", "; "))


@query(_tables_sql("border"))
def grid_border_tables(spark, sf_dir):
    """Border mode: neighbours connect by lines alone."""
    found = grid.detect_tables(cells(spark, sf_dir), sheet_merges(spark, sf_dir), mode="border")
    return found.withColumn("reasons", F.array_join("reasons", "; "))


def _merges(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    r, c = F.col("user_id") % 40 + 1, F.col("event_id") % 9 + 1
    return e.select(F.lit(0).alias("sheet_index"), F.col("event_id").alias("ord"), r.cast("int").alias("start_row"), c.cast("int").alias("start_col"), (r + F.col("event_id") % 3).cast("int").alias("end_row"), (c + F.col("event_id") % 2).cast("int").alias("end_col"))


_MERGES = "m as (select event_id as ord, (user_id % 40 + 1)::int as r1, (event_id % 9 + 1)::int as c1, (user_id % 40 + 1 + event_id % 3)::int as r2, (event_id % 9 + 1 + event_id % 2)::int as c2 from events)"


@query(f"""with {_MERGES}, g as (select r, c from range(1, 44) a(r), range(1, 12) b(c)) select r::int as row, c::int as col,
    coalesce(arg_max(case when g.r = m.r1 then '[MERGED←]' else '[MERGED↑]' end, m.ord), g.r || ':' || g.c) as value
    from g left join m on g.r between m.r1 and m.r2 and g.c between m.c1 and m.c2 and not (g.r = m.r1 and g.c = m.c1) group by g.r, g.c""")
def grid_merge_tokens(spark, sf_dir):
    rows, cols = spark.range(1, 44).select(F.col("id").cast("int").alias("row")), F.sequence(F.lit(1), F.lit(11))
    g = rows.withColumn("col", F.explode(cols)).withColumn("sheet_index", F.lit(0)).withColumn("value", F.concat_ws(":", "row", "col"))
    return grid.merge_tokens(g, _merges(spark, sf_dir), ["sheet_index"]).select("row", "col", "value")


@query("""with b as (select l_orderkey, l_linenumber, l_linenumber between 2 and 5 as a, l_linenumber between 4 and 9 as z, l_quantity from lineitem)
    select l_orderkey, round(sum(case when a and z then l_quantity else 0 end), 2) as both from b group by l_orderkey""")
def op_intersection(spark, sf_dir):
    """The space operator: two column ranges of a sheet meet in a rectangle, whose cells are summed.

    An order is a row of a sheet, its lines are the columns; 1000 rows are a workbook."""
    t = table(spark, sf_dir, "lineitem").withColumns({"workbook": F.expr("cast(l_orderkey div 1000 as string)"), "row": (F.col("l_orderkey") % 1000 + 1).cast("int")})
    at, nothing = ["workbook", "row"], F.lit(None).cast("string")
    lines = t.groupBy(*at, F.col("l_linenumber").cast("int").alias("col")).agg(F.sum("l_quantity").cast("string").alias("value")).withColumn("formula", nothing)
    sums = t.select(*at).distinct().select(*at, F.lit(10).alias("col"), nothing.alias("value"), F.expr("concat('SUM(B', row, ':E', row, ' D', row, ':I', row, ')')").alias("formula"))
    cells = lines.unionByName(sums).select("workbook", F.lit(0).alias("sheet_index"), F.lit("Orders").alias("sheet_name"), F.lit(0).alias("ord"), "row", "col", "formula", F.col("formula").isNotNull().alias("pending"), F.lit(False).alias("empty"), "value")
    names = spark.createDataFrame([], "workbook string, sheet string, name string, formula string")
    tables = spark.createDataFrame([], "workbook string, sheet string, name string, start string, end string, columns array<string>, header_rows int, totals_rows int")
    order = (F.col("workbook").cast("long") * 1000 + F.col("row") - 1).cast(t.schema["l_orderkey"].dataType)
    return rounded(evaluate.resolve(cells, names, tables).select(order.alias("l_orderkey"), F.col("resolved").cast("double").alias("both")), "both")


@query(f"""with {_MERGES}, r as (select m.*, unnest(range(r1, r2 + 1)) as row from m), p as (select ord, row, unnest(range(c1, c2 + 1)) as col from r) select row::int as row, col::int as col, count(*)::bigint as boxes, max(ord)::bigint as latest from p group by row, col""")
def grid_dense(spark, sf_dir):
    """Every place of every box."""
    return grid.dense_grid(_merges(spark, sf_dir)).groupBy("row", "col").agg(F.count("*").alias("boxes"), F.max("ord").cast("bigint").alias("latest"))


@query("""with g as (select l_orderkey as k, l_linenumber as c, max(case when l_quantity > 25 then l_returnflag else ' ' end) as v, max(l_suppkey % 3) as w from lineitem group by all),
    b as (select k, min(c) as c1, max(c) as c2 from g group by k), x as (select k, c1, c2, unnest(range(c1, c2 + 1)) as c from b),
    f as (select x.k, x.c, case when x.c = x.c1 + 1 and x.k % 2 = 0 then '[MERGED←]' else coalesce(trim(g.v), '') end as upper, coalesce(g.w::varchar, '') as lower from x left join g using (k, c))
    select k, case when bool_or(upper not in ('', '[MERGED←]')) then string_agg(upper, '|' order by c) filter (where upper not in ('', '[MERGED←]') or lower <> '') end as upper,
      string_agg(lower, '|' order by c) filter (where upper not in ('', '[MERGED←]') or lower <> '') as lower, bool_or(upper not in ('', '[MERGED←]')) as shown from f group by k""")
def grid_matrix(spark, sf_dir):
    """Sparse cells to dense rows, merges marked, empty rows and columns left out: two rows of cells for each order.  An upper
    row without text is left out."""
    t = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("int").alias("col"))
    t = t.agg(F.max(F.when(F.col("l_quantity") > 25, F.col("l_returnflag")).otherwise(" ")).alias("v"), F.max(F.col("l_suppkey") % 3).cast("string").alias("w"))
    at = [F.col("k").cast("string").alias("workbook"), F.lit(1).alias("sheet_index")]
    box = t.groupBy("k").agg(F.lit(1).alias("start_row"), F.min("col").alias("start_col"), F.lit(2).alias("end_row"), F.max("col").alias("end_col"))
    merges = box.where("k % 2 = 0 and end_col > start_col").select(*at, "start_row", "start_col", F.lit(1).alias("end_row"), (F.col("start_col") + 1).alias("end_col"), F.lit(0).alias("ord"))
    lines = t.select(*at, F.explode(F.array(F.struct(F.lit(1).alias("row"), "col", F.col("v").alias("value")), F.struct(F.lit(2).alias("row"), "col", F.col("w").alias("value")))).alias("c")).select("workbook", "sheet_index", "c.*")
    made = grid.matrices(box.select("k", *at, "start_row", "start_col", "end_row", "end_col"), lines, merges)
    both = F.size("matrix") > 1
    upper = F.when(both, F.array_join(F.col("matrix")[0], "|"))
    return made.select("k", upper.alias("upper"), F.array_join(F.element_at("matrix", -1), "|").alias("lower"), both.alias("shown"))


# ---------------------------------------------------------------- layout


def event_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as cells: a sheet for each user, a row for each day, a column for each hour."""
    e = table(spark, sf_dir, "events")
    at = e.select(F.lit("events").alias("workbook"), F.col("user_id").cast("int").alias("sheet_index"), F.day("ts").cast("int").alias("row"), (F.hour("ts") + 1).cast("int").alias("col"), "event_type", "event_id")
    return at.groupBy("workbook", "sheet_index", "row", "col").agg(F.min_by("event_type", "event_id").alias("value"))


_EVENTS = "ec as (select user_id::int as sheet_index, day(ts)::int as row, (hour(ts) + 1)::int as col, arg_min(event_type, event_id) as value from events group by all)"
_SEGMENTS = f"""{_EVENTS}, g1 as (select *, case when col - lag(col) over (partition by sheet_index, row order by col) <= 4 then 0 else 1 end as f from ec),
    g2 as (select *, sum(f) over (partition by sheet_index, row order by col) as seg from g1),
    sg as (select sheet_index, row, seg, min(col)::int as start_col, string_agg(value, ' ' order by col) as text from g2 group by sheet_index, row, seg)"""


@query(f"with {_SEGMENTS} select sheet_index, row, start_col, text from sg")
def layout_row_segments(spark, sf_dir):
    return layout.row_segments(event_cells(spark, sf_dir)).select("sheet_index", "row", "start_col", "text")


_BLOCKS = f"""{_SEGMENTS}, so as (select *, row_number() over (partition by sheet_index order by row, start_col) as i from sg),
    fold(sheet_index, i, row, col, first_col, block, text) as (select sheet_index, i, row, start_col, start_col, 1, text from so where i = 1 union all
      select s.sheet_index, s.i, s.row, s.start_col, case when s.row - f.row > 1 or abs(s.start_col - f.first_col) > 3 then s.start_col else f.first_col end, f.block + case when s.row - f.row > 1 or abs(s.start_col - f.first_col) > 3 then 1 else 0 end, s.text
      from fold f join so s on s.sheet_index = f.sheet_index and s.i = f.i + 1),
    items as (select *, row_number() over (partition by sheet_index, block order by i) as k, lead(col) over (partition by sheet_index, block order by i) as next from fold),
    told(sheet_index, block, k, head, part, line, text) as (select sheet_index, block, k, case when next > col then col end, 1, false, case when next > col then '### ' || text else text end from items where k = 1 union all
      select x.sheet_index, x.block, x.k, case when t.head is not null and x.col > t.head then t.head when x.next > x.col then x.col end, t.part + case when t.head is not null and x.col > t.head and t.line then 0 else 1 end,
        t.head is not null and x.col > t.head, case when t.head is not null and x.col > t.head then '- ' || x.text when x.next > x.col then '### ' || x.text else x.text end
      from told t join items x on x.sheet_index = t.sheet_index and x.block = t.block and x.k = t.k + 1)"""


@query(f"""with recursive {_BLOCKS}, parts as (select sheet_index, block, part, string_agg(text, chr(10) order by k) as text from told group by sheet_index, block, part),
    texts as (select sheet_index, block, string_agg(text, chr(10) || chr(10) order by part) as text from parts group by sheet_index, block)
    select i.sheet_index, i.block::int as block, arg_min(row, k)::int as start_row, arg_min(col, k)::int as start_col, arg_max(row, k)::int as end_row, max(col)::int as end_col, min(t.text) as text, coalesce(bool_or(k = 1 and next > col), false) as heading
    from items i join texts t on t.sheet_index = i.sheet_index and t.block = i.block group by i.sheet_index, i.block""")
def layout_narrative_blocks(spark, sf_dir):
    b = layout.narrative_blocks(layout.row_segments(event_cells(spark, sf_dir)))
    return b.select("sheet_index", "block", "start_row", "start_col", "end_row", "end_col", layout.narrative_text(F.col("items")).alias("text"), layout.is_heading_block(F.col("items")).alias("heading"))


@query(f"with {_EVENTS} select sheet_index, row, col, value from ec where not (row between 5 and 9 and col between 1 + sheet_index % 5 and 12)")
def layout_outside(spark, sf_dir):
    """Cells that no table covers."""
    c = event_cells(spark, sf_dir)
    tables = c.select("workbook", "sheet_index").distinct().select("workbook", "sheet_index", F.lit(5).alias("start_row"), (1 + F.col("sheet_index") % 5).alias("start_col"), F.lit(9).alias("end_row"), F.lit(12).alias("end_col"))
    return layout.outside(c, tables).select("sheet_index", "row", "col", "value")


@query("""with a as (select user_id::int as sheet_index, day(ts)::int * 3 as r1, (hour(ts) + 1)::int as c1, day(ts)::int * 3 + (event_id % 4)::int as r2, (hour(ts) + 2)::int as c2 from events),
    p as (select *, max(r2) over (partition by sheet_index order by r1, c1, r2, c2 rows between unbounded preceding and 1 preceding) as reach from a),
    s as (select *, sum(case when reach is null or r1 - reach > 4 then 1 else 0 end) over (partition by sheet_index order by r1, c1, r2, c2 rows between unbounded preceding and current row) as section from p)
    select sheet_index, section::int as section, min(r1) as start_row, min(c1) as start_col, max(r2) as end_row, max(c2) as end_col from s group by sheet_index, section""")
def layout_sections(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    row, col = F.day("ts").cast("int") * 3, (F.hour("ts") + 1).cast("int")
    a = e.select(F.col("user_id").cast("int").alias("sheet_index"), row.alias("start_row"), col.alias("start_col"), (row + (F.col("event_id") % 4).cast("int")).alias("end_row"), (col + 1).alias("end_col"))
    return layout.sections(a, ["sheet_index"])


@query("select o_orderkey, o_custkey, lpad(row_number() over (partition by o_custkey order by o_orderdate, o_orderkey)::varchar, 3, '0') as no from orders")
def layout_numbering(spark, sf_dir):
    return layout.numbered(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_orderkey", "o_custkey", "no")


# ---------------------------------------------------------------- shapes


def _boxes(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    left, top = F.col("p_partkey") % 20 * 3_000_000 + F.col("p_partkey") * 7919 % 1_900_000, F.floor(F.col("p_partkey") / 20) % 50 * 1_300_000
    return p.select(F.floor(F.col("p_partkey") / 1000).cast("int").alias("sheet_index"), F.col("p_partkey").alias("no"), left.alias("left"), top.alias("top"), (left + F.col("p_size") * 20_000).alias("right"), (top + F.col("p_size") * 10_000).alias("bottom"))


_BOXES = "bx as (select (p_partkey // 1000)::int as s, p_partkey as no, p_partkey % 20 * 3000000 + p_partkey * 7919 % 1900000 as l, (p_partkey // 20) % 50 * 1300000 as t, p_partkey % 20 * 3000000 + p_partkey * 7919 % 1900000 + p_size * 20000 as r, (p_partkey // 20) % 50 * 1300000 + p_size * 10000 as b from part)"


@query(f"""with {_BOXES} select x.s as sheet_index, x.no as a, y.no as b from bx x join bx y on x.s = y.s and x.no < y.no
    and greatest(0, y.l - x.r, x.l - y.r) <= 2438400 and greatest(0, y.t - x.b, x.t - y.b) <= 1143000""")
def shape_gap_edges(spark, sf_dir):
    return shapes.gap_edges(_boxes(spark, sf_dir), ["sheet_index"])


@query(f"""with recursive {_BOXES}, near as (select x.s, x.no as p, y.no as q from bx x join bx y on x.s = y.s and x.no <> y.no and greatest(0, y.l - x.r, x.l - y.r) <= 2438400 and greatest(0, y.t - x.b, x.t - y.b) <= 1143000),
    c(s, no, label) using key (s, no) as (select s, no, no from bx union select n.s, n.q, min(c.label) from c join near n on n.s = c.s and n.p = c.no join recurring.c o on o.s = n.s and o.no = n.q where c.label < o.label group by n.s, n.q)
    select c.s as sheet_index, (min(t) // 190500 + 1)::int as start_row, (min(l) // 609600 + 1)::int as start_col, (max(b) // 190500 + 1)::int as end_row, (max(r) // 609600 + 1)::int as end_col, string_agg(c.no::varchar, ',' order by c.no) as shapes
    from c join bx using (s, no) group by c.s, c.label""")
def shape_blocks(spark, sf_dir):
    return shapes.blocks(_boxes(spark, sf_dir), ["sheet_index"]).withColumn("shapes", F.array_join(F.transform("shapes", lambda x: x.cast("string")), ","))


# ---------------------------------------------------------------- Markdown

_ESCAPED = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace({0}, '\', '\\'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'),
    '([`*_{{}}\[\]()!|~])', '\\\1', 'g'), '(?m)^#', '\\#', 'g'), '(?m)^([-+])([ \t])', '\\\1\2', 'g'), '(?m)^([0-9]+)\.([ \t])', '\1\\.\2', 'g')"""
_NORMAL = r"replace(regexp_replace(regexp_replace({0}, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{{9F}}\x{{AD}}\x{{200B}}-\x{{200F}}\x{{2028}}-\x{{202E}}\x{{2060}}-\x{{206F}}\x{{FEFF}}]', ' ', 'g'), '\r\n?|\n', ' ', 'g'), chr(9), ' ')"


@query(f"select doc_id, md5({_ESCAPED.format('text')}) as escaped from documents")
def md_escape(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(markdown.escape(F.col("text")).cast("binary")).alias("escaped"))


@query(f"select doc_id, md5({_NORMAL.format('text')}) as line, md5(replace({_NORMAL.format('text')}, '|', '\\|')) as cell, md5(regexp_replace({_NORMAL.format('text')}, '^#+\\s*', '')) as heading from documents")
def md_normalize(spark, sf_dir):
    t, digest = F.col("text"), lambda c: F.md5(c.cast("binary"))
    return table(spark, sf_dir, "documents").select("doc_id", digest(markdown.normalize(t)).alias("line"), digest(markdown.table_cell(t)).alias("cell"), digest(markdown.heading(t)).alias("heading"))


@query(f"select doc_id, md5(trim(regexp_replace({_NORMAL.format(_ESCAPED.format('text'))}, '\\s+', ' ', 'g'))) as compact from documents")
def md_compact(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(markdown.compact(F.col("text")).cast("binary")).alias("compact"))


@query("""select '| r | nation | n |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || r_name || ' | ' || n_name || ' | ' || n_nationkey || ' |', chr(10) order by n_nationkey) as markdown from nation join region on n_regionkey = r_regionkey""")
def md_table(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    row = F.struct("n_nationkey", F.array("r_name", "n_name", F.col("n_nationkey").cast("string")).alias("cells"))
    rows = n.agg(F.array_sort(F.collect_list(row)).alias("x")).select(F.transform("x", lambda r: r["cells"]).alias("rows"))
    head = F.array(F.array(F.lit("r"), F.lit("nation"), F.lit("n")))
    return rows.select(markdown.table(F.concat(head, F.col("rows"))).alias("markdown"))


@query("select page_id, '[' || page_id || '](' || url || ')' as link from pages")
def md_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", markdown.link(F.col("page_id").cast("string"), F.col("url")).alias("link"))


@query(r"""select page_id, regexp_replace(regexp_replace(regexp_replace(lower(trim(title)), '<[^>]+>', '', 'g'), '[^\p{L}\p{N}\s_-]+', '', 'g'), '\s+', '-', 'g') as fragment,
    '[x](#' || regexp_replace(regexp_replace(regexp_replace(lower(trim(title)), '<[^>]+>', '', 'g'), '[^\p{L}\p{N}\s_-]+', '', 'g'), '\s+', '-', 'g') || ') (' || title || '!A1)' as internal
    from (select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title from pages)""")
def md_heading_fragment(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    sheet, ref = F.col("title"), F.lit("A1")
    return p.select("page_id", markdown.fragment(F.col("title")).alias("fragment"), markdown.internal_link(F.lit("x"), sheet, ref, F.lit(True)).alias("internal"))


_MARKED = """case when {b} then '**' else '' end || case when {i} then '*' else '' end || case when {s} then '~~' else '' end || case when {u} then '<ins>' else '' end || {t} || case when {u} then '</ins>' else '' end || case when {s} then '~~' else '' end || case when {i} then '*' else '' end || case when {b} then '**' else '' end"""


@query(f"""with r as (select c_custkey, c_name || c_mktsegment as x, c_acctbal > 5000 as b, c_nationkey % 2 = 0 as i, c_nationkey % 3 = 0 as s, c_nationkey % 5 = 0 as u from customer)
    select c_custkey, case when s then {_MARKED.format(b="b", i="i", s="s", u="u", t="x || '.'")} else {_MARKED.format(b="b", i="i", s="s", u="u", t="x")} || {_MARKED.format(b="b", i="i", s="true", u="u", t="'.'")} end as styled, case when s then 1 else 2 end::int as runs from r""")
def md_rich_github(spark, sf_dir):
    """Three runs, of which the first two have one style and are merged; the third is struck, as a whole cell may be."""
    c = table(spark, sf_dir, "customer")
    n = F.col("c_nationkey")
    flags = ("bold", "italic", "strike", "underline")
    style = F.struct((F.col("c_acctbal") > 5000).alias("bold"), (n % 2 == 0).alias("italic"), (n % 3 == 0).alias("strike"), (n % 5 == 0).alias("underline"))
    run = lambda text, **on: F.struct(text.alias("text"), *[F.lit(on.get(f, False)).alias(f) for f in flags])
    merged = markdown.merge_runs(F.array(run(F.col("c_name")), run(F.col("c_mktsegment")), run(F.lit("."), strike=True)), style)
    text = F.concat("c_name", "c_mktsegment", F.lit("."))
    return c.select("c_custkey", markdown.github_text(text, style, merged).alias("styled"), F.size(merged).alias("runs"))


@query(r"""select doc_id, md5(regexp_replace(regexp_replace(regexp_replace(t, '^(\s*)([#>])', '\1\\\2'), '^(\s*)([-+*])(\s+)', '\1\\\2\3'), '^(\s*)([0-9]+)\.(\s+)', '\1\2\\.\3')) as line
    from (select doc_id, case doc_id % 4 when 0 then '# ' when 1 then ' - ' when 2 then '12. ' else '' end || left(text, 40) as t from documents)""")
def md_line_start(spark, sf_dir):
    mark = F.when(F.col("doc_id") % 4 == 0, "# ").when(F.col("doc_id") % 4 == 1, " - ").when(F.col("doc_id") % 4 == 2, "12. ").otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(markdown.escape_line_start(F.concat(mark, F.left("text", F.lit(40)))).cast("binary")).alias("line"))


# ---------------------------------------------------------------- diagnostics and export


@query("""select o_orderpriority as workbook, 1 as sheet_index, case o_orderstatus when 'F' then 'resolved' when 'O' then 'fallback_formula' else 'unsupported_external' end as status,
    case when o_orderstatus = 'F' and o_orderkey % 2 = 0 then 'cached_value' when o_orderstatus = 'F' then 'ast_evaluator' when o_orderstatus = 'O' then 'formula_text' else 'external_unsupported' end as source, count(*)::bigint as n
    from orders where o_orderkey % 5 <> 0 group by all""")
def summary_counts(spark, sf_dir):
    """Formulas by state and source; cells without a formula do not count."""
    status = F.col("o_orderstatus")
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("workbook"), F.lit(1).alias("sheet_index"), F.when(F.col("o_orderkey") % 5 == 0, "").otherwise("=A1").alias("formula"),
        F.when(status == "F", "resolved").when(status == "O", "fallback_formula").otherwise("unsupported_external").alias("resolution_status"),
        F.when((status == "F") & (F.col("o_orderkey") % 2 == 0), "cached_value").when(status == "F", "ast_evaluator").when(status == "O", "formula_text").otherwise("external_unsupported").alias("resolution_source"),
    )
    return export.formula_counts(o)


@query("select p_partkey, case when p_size % 10 >= 7 then 'strong' when p_size % 10 >= 4 then 'candidate' else 'weak' end as label from part")
def summary_labels(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", export.score_label(F.col("p_size") % 10).alias("label"))


@query("""with f as (select case n_nationkey % 3 when 0 then 'SUM,IF' when 1 then 'SUM' else 'VLOOKUP,IF,SUM' end as fs from nation) select fn as function, count(*)::bigint as n from (select unnest(string_split(fs, ',')) as fn from f) group by fn order by n desc, fn limit 12""")
def formula_histogram(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey") % 3
    formula = F.when(k == 0, "=SUM(IF(A1>1,A2,A3))").when(k == 1, "=SUM(A1:A9)").otherwise('=VLOOKUP(A1,B1:C9,IF(SUM(D1)>1,2,3),FALSE)')
    return export.function_histogram(n.withColumn("formula", formula))


@query("select c_custkey, hex(encode(c_name)) as utf8, 'EFBBBF' || hex(encode(c_name)) as marked from customer")
def export_encode(spark, sf_dir):
    c, name = table(spark, sf_dir, "customer"), F.col("c_name")
    return c.select("c_custkey", F.hex(export.encoded(name)).alias("utf8"), F.hex(export.encoded(name, "utf-8", "on")).alias("marked"))


@query("""with h as (select c_custkey, hex(encode(c_name)) as h from customer), l as (select c_custkey, h, regexp_replace(h, '(..)', '\\1\\0', 'g') as x from h)
    select c_custkey, h || 'C3A9E6BCA2' as utf_8, regexp_replace(h, '(..)', '\\100', 'g') || 'E900226F' as utf_16le, regexp_replace(h, '(..)', '00\\1', 'g') || '00E96F22' as utf_16be,
      regexp_replace(h, '(..)', '\\1000000', 'g') || 'E9000000226F0000' as utf_32le, regexp_replace(h, '(..)', '000000\\1', 'g') || '000000E900006F22' as utf_32be, h || '3F8ABF' as shift_jis from h""")
def export_encodings(spark, sf_dir):
    """Each encoding of a name and two more letters, one of which Shift_JIS lacks."""
    c, name = table(spark, sf_dir, "customer"), F.concat("c_name", F.lit("é漢"))
    return c.select("c_custkey", *[F.hex(export.encoded(name, e)).alias(e.replace("-", "_")) for e in export.ENCODINGS])


@query(r"""select c_custkey, regexp_replace(c_name, '[^A-Za-z0-9._-]+', '_', 'g') || '_' || lpad(c_nationkey::varchar, 3, '0') || '_' || case c_custkey % 3 when 0 then 'Sheet' || c_nationkey when 1 then c_mktsegment || '_x.1' else 'full_' || c_mktsegment end || '.md' as name from customer""")
def export_file_names(spark, sf_dir):
    """Names that need a fallback, hold signs that no file system takes, or wide letters."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey") % 3
    sheet = F.when(k == 0, " ?/ ").when(k == 1, F.concat(F.lit(" "), "c_mktsegment", F.lit(" : x.1__"))).otherwise(F.concat(F.lit("ｆｕｌｌ*"), "c_mktsegment"))
    return c.select("c_custkey", export.file_name(F.concat(F.lit("s3://a/b.c/"), "c_name", F.lit(".xlsx")), F.col("c_nationkey"), sheet).alias("name"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customers' segment (a first-match lookup), price sums by segment, as lines of a Markdown table."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    orders = lookups.exact(orders, F.col("o_custkey"), customers, "c_custkey", "c_mktsegment", "segment", "c_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    sums = aggregate(lines, ["segment"], large='=SUMIFS([l_extendedprice],[l_quantity],">25")', total="=SUM([l_extendedprice])")
    text = lambda c: column(sums, f'=TEXT([{c}],"#,##0.00")')
    row = F.array(F.col("segment"), text("large"), text("total"))
    return sums.select("segment", F.concat(F.lit("| "), F.array_join(F.transform(row, markdown.table_cell), " | "), F.lit(" |")).alias("line")).orderBy("segment")


SQL["flagship"] = """with o as (select o_orderkey, coalesce(c_mktsegment, '#N/A') as segment from orders left join customer on o_custkey = c_custkey)
    select segment, '| ' || segment || ' | ' || format('{:,.2f}', sum(case when l_quantity > 25 then l_extendedprice else 0 end)) || ' | ' || format('{:,.2f}', sum(l_extendedprice)) || ' |' as line
    from lineitem join o on l_orderkey = o_orderkey group by segment"""
QUERIES["flagship"] = flagship

from . import catalog_workbooks  # noqa: E402, F401  registers its queries here
