"""The registered queries over the given tables, each beside the same in DuckDB's SQL where SQL expresses it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomsheet.functions import cells as C
from loomsheet.functions import scalar as S
from loomsheet.functions import text as T
from loomsheet.functions.volatile import rand
from loomsheet.operators import aggregates, edits, lookups, spills, trees
from loomsheet.plans import graph, ordered
from loomsheet.sources.tables import shared_dir, sheet
from loomsheet.sources.workbook import Workbook, unaccounted, with_cached
from loomsheet.streaming import topics

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _formula(name: str, table: str, key: str, cell, sql: str) -> None:
    """A region of one formula over the rows of a table: key, v and e. cell is a function of no arguments, called later."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return sheet(spark, folder, table).select(key, *cell().columns())

    run.__name__ = name
    QUERIES[name] = run
    ORACLES[name] = f"select {key}, {sql} from {table}"


_OK = "cast(null as varchar) as e"
_HALF = "case when abs({0}) - floor(abs({0})) >= 0.5 then 1 else 0 end"
col = C.cell
# formulas over numbers of one row -----------------------------------------------------------------------------------
_formula("region_copy", "orders", "o_orderkey", lambda: col("o_totalprice"), f"o_totalprice as v, {_OK}")
_formula("region_double", "orders", "o_orderkey", lambda: col("o_totalprice") * 2, f"o_totalprice*2 as v, {_OK}")
_formula("expr_precedence", "part", "p_partkey", lambda: col("p_retailprice") + col("p_size") * col("p_retailprice"), f"p_retailprice+p_size*p_retailprice as v, {_OK}")
_formula("expr_parentheses", "part", "p_partkey", lambda: (col("p_retailprice") + col("p_size")) * col("p_size"), f"(p_retailprice+p_size)*p_size as v, {_OK}")
_formula("expr_subtract_negate", "part", "p_partkey", lambda: -(col("p_retailprice") - col("p_size")) * 2 + 1, f"-(p_retailprice-p_size)*2+1 as v, {_OK}")
_formula("expr_divide", "orders", "o_orderkey", lambda: col("o_totalprice") / 2, f"o_totalprice/2 as v, {_OK}")
_P5 = lambda: col(F.col("p_size") % 5)
_formula("div_error", "part", "p_partkey", lambda: col("p_retailprice") / _P5(), "case when p_size%5<>0 then p_retailprice/(p_size%5) end as v, case when p_size%5=0 then '#DIV/0!' end as e")
_formula("div_error_propagates", "part", "p_partkey", lambda: col("p_retailprice") / _P5() + 1, "case when p_size%5<>0 then p_retailprice/(p_size%5)+1 end as v, case when p_size%5=0 then '#DIV/0!' end as e")
_formula("error_left_wins", "part", "p_partkey", lambda: S.sqrt(col(25) - col("p_size")) + col("p_retailprice") / _P5(), "case when p_size<=25 and p_size%5<>0 then sqrt(25.0-p_size)+p_retailprice/(p_size%5) end as v, case when p_size>25 then '#NUM!' when p_size%5=0 then '#DIV/0!' end as e")
_formula("iferror", "part", "p_partkey", lambda: C.iferror(col("p_retailprice") / _P5(), 0), f"case when p_size%5=0 then 0.0 else p_retailprice/(p_size%5) end as v, {_OK}")
for _name, _op, _sql in (("lt", lambda a, b: a < b, "<"), ("le", lambda a, b: a <= b, "<="), ("eq", lambda a, b: a.equals(b), "="), ("ne", lambda a, b: a.differs(b), "<>"), ("gt", lambda a, b: a > b, ">"), ("ge", lambda a, b: a >= b, ">=")):
    _formula(f"compare_{_name}", "part", "p_partkey", lambda op=_op: op(col("p_size") * 2, col("p_retailprice") / 20), f"(p_size*2 {_sql} p_retailprice/20) as v, {_OK}")
_formula("compare_iferror", "part", "p_partkey", lambda: C.iferror(col("p_retailprice") / _P5(), 0) > 0, f"(case when p_size%5=0 then 0.0 else p_retailprice/(p_size%5) end > 0) as v, {_OK}")
_A, _B = lambda: col("o_totalprice") > 100000, lambda: col("o_custkey") > 500
_formula("logical_and", "orders", "o_orderkey", lambda: C.and_(_A(), _B()), f"(o_totalprice>100000 and o_custkey>500) as v, {_OK}")
_formula("logical_or", "orders", "o_orderkey", lambda: C.or_(_A(), _B()), f"(o_totalprice>100000 or o_custkey>500) as v, {_OK}")
_formula("logical_not", "orders", "o_orderkey", lambda: C.not_(C.and_(_A(), _B())), f"not (o_totalprice>100000 and o_custkey>500) as v, {_OK}")
_formula("logical_error_wins", "part", "p_partkey", lambda: C.or_(col("p_size") > 0, col("p_retailprice") / _P5() > 1), "case when p_size%5<>0 then true end as v, case when p_size%5=0 then '#DIV/0!' end as e")
_formula("if_branch", "customer", "c_custkey", lambda: C.if_(col("c_acctbal") > 0, col("c_acctbal") * 2, col("c_acctbal") / 2), f"case when c_acctbal>0 then c_acctbal*2 else c_acctbal/2 end as v, {_OK}")
_formula("if_nested", "customer", "c_custkey", lambda: C.if_(col("c_acctbal") > 5000, C.if_(col("c_nationkey") > 10, col("c_acctbal") * 2, col("c_acctbal") * 3), C.if_(col("c_nationkey") > 10, col("c_acctbal") + 1, col("c_acctbal") - 1)), f"case when c_acctbal>5000 then case when c_nationkey>10 then c_acctbal*2 else c_acctbal*3 end else case when c_nationkey>10 then c_acctbal+1 else c_acctbal-1 end end as v, {_OK}")
_formula("if_logical", "orders", "o_orderkey", lambda: C.if_(C.and_(_A(), _B()), col("o_totalprice") + col("o_custkey"), 0), f"case when o_totalprice>100000 and o_custkey>500 then o_totalprice+o_custkey else 0.0 end as v, {_OK}")
_formula("if_hides_error", "part", "p_partkey", lambda: C.if_(_P5().equals(0), 0, col("p_retailprice") / _P5()), f"case when p_size%5=0 then 0.0 else p_retailprice/(p_size%5) end as v, {_OK}")
# aggregates over arguments and ranges of one row
_formula("agg_row_sum", "part", "p_partkey", lambda: C.sum_("p_size", "p_retailprice", 5), f"p_size+p_retailprice+5 as v, {_OK}")
_formula("agg_row_sumsq", "part", "p_partkey", lambda: C.sumsq("p_size", "p_retailprice"), f"p_size*p_size+p_retailprice*p_retailprice as v, {_OK}")
_formula("agg_row_count", "part", "p_partkey", lambda: C.count("p_size", "p_retailprice", F.when(F.col("p_size") > 25, 1.0)), f"case when p_size>25 then 3.0 else 2.0 end::double as v, {_OK}")
_formula("agg_row_product", "part", "p_partkey", lambda: C.product("p_size", "p_retailprice", 2), f"p_size*p_retailprice*2 as v, {_OK}")
_formula("agg_row_average", "part", "p_partkey", lambda: C.average("p_size", "p_retailprice"), f"(p_size+p_retailprice)/2 as v, {_OK}")
_formula("agg_row_min", "part", "p_partkey", lambda: C.min_("p_size", "p_retailprice", 20), f"least(p_size,p_retailprice,20.0)::double as v, {_OK}")
_formula("agg_row_max", "part", "p_partkey", lambda: C.max_("p_size", F.col("p_retailprice") - 900, 20), f"greatest(p_size,p_retailprice-900,20.0)::double as v, {_OK}")
_formula("agg_row_error", "part", "p_partkey", lambda: C.iferror(C.sum_("p_size", col("p_retailprice") / _P5()), -1), f"case when p_size%5=0 then -1.0 else p_size+p_retailprice/(p_size%5) end as v, {_OK}")
# scalar functions
_X = lambda: col("c_acctbal")
_formula("fn_abs", "customer", "c_custkey", lambda: S.abs_(_X()), f"abs(c_acctbal) as v, {_OK}")
_formula("fn_sqrt", "customer", "c_custkey", lambda: S.sqrt(_X()), "case when c_acctbal>=0 then sqrt(c_acctbal) end as v, case when c_acctbal<0 then '#NUM!' end as e")
_formula("fn_power", "part", "p_partkey", lambda: S.power("p_size", 2), f"(p_size*p_size)::double as v, {_OK}")
_formula("fn_mod", "customer", "c_custkey", lambda: S.mod(_X(), 7), f"c_acctbal-7*floor(c_acctbal/7) as v, {_OK}")
_formula("fn_mod_sign", "part", "p_partkey", lambda: S.mod("p_size", -3), f"p_size+3*floor(p_size/-3.0) as v, {_OK}")
_formula("fn_mod_error", "part", "p_partkey", lambda: S.mod("p_retailprice", _P5()), "case when p_size%5<>0 then p_retailprice-(p_size%5)*floor(p_retailprice/(p_size%5)) end as v, case when p_size%5=0 then '#DIV/0!' end as e")
_formula("fn_round", "customer", "c_custkey", lambda: S.round_(_X(), 1), f"sign(c_acctbal)*(floor(abs(c_acctbal*10))+{_HALF.format('c_acctbal*10')})/10 + 0.0 as v, {_OK}")
_formula("fn_round_negative", "customer", "c_custkey", lambda: S.round_(_X(), -2), f"sign(c_acctbal)*(floor(abs(c_acctbal/100))+{_HALF.format('c_acctbal/100')})*100 + 0.0 as v, {_OK}")
_formula("fn_roundup", "customer", "c_custkey", lambda: S.roundup(_X(), 1), f"case when c_acctbal<0 then floor(c_acctbal*10) else ceil(c_acctbal*10) end/10 + 0.0 as v, {_OK}")
_formula("fn_rounddown", "customer", "c_custkey", lambda: S.rounddown(_X(), 1), f"case when c_acctbal<0 then ceil(c_acctbal*10) else floor(c_acctbal*10) end/10 + 0.0 as v, {_OK}")
_formula("fn_int", "customer", "c_custkey", lambda: S.int_(_X()), f"floor(c_acctbal) as v, {_OK}")
_formula("fn_trunc", "customer", "c_custkey", lambda: S.trunc(_X()), f"case when c_acctbal<0 then ceil(c_acctbal) else floor(c_acctbal) end + 0.0 as v, {_OK}")


def _rounded(f, digits: int = 8):
    def cell():
        x = f()
        return C.Cell(F.round(x.num, digits), x.err)

    return cell


_formula("fn_power_error", "customer", "c_custkey", _rounded(lambda: S.power(_X(), 0.5), 6), "case when c_acctbal>=0 then round(sqrt(c_acctbal),6) end as v, case when c_acctbal<0 then '#NUM!' end as e")
_formula("fn_exp", "part", "p_partkey", _rounded(lambda: S.exp(col("p_size") / 10)), f"round(exp(p_size/10),8) as v, {_OK}")
for _name, _f, _sql in (("fn_ln", S.ln, "ln"), ("fn_log10", S.log10, "log10")):
    _formula(_name, "customer", "c_custkey", _rounded(lambda f=_f: f(_X())), f"case when c_acctbal>0 then round({_sql}(c_acctbal),8) end as v, case when c_acctbal<=0 then '#NUM!' end as e")
_formula("fn_log_base", "part", "p_partkey", _rounded(lambda: S.log("p_retailprice", "p_size")), "case when p_size<>1 then round(case when p_size=10 then log10(p_retailprice) when p_size=2 then log2(p_retailprice) else ln(p_retailprice)/ln(p_size) end,8) end as v, case when p_size=1 then '#DIV/0!' end as e")
for _name, _f in (("sin", S.sin), ("cos", S.cos), ("tan", S.tan)):
    _formula(f"fn_{_name}", "part", "p_partkey", _rounded(lambda f=_f: f("p_size")), f"round({_name}(p_size),8) as v, {_OK}")
_formula("fn_radians", "part", "p_partkey", lambda: S.radians("p_size"), f"p_size*pi()/180.0 as v, {_OK}")
_formula("fn_degrees", "part", "p_partkey", lambda: S.degrees("p_size"), f"p_size*180.0/pi() as v, {_OK}")
_formula("fn_pi", "part", "p_partkey", lambda: S.pi() * col("p_size"), f"pi()*p_size as v, {_OK}")


# text ------------------------------------------------------------------------------------------------------------------


@_query("select doc_id, case when text is not null then (length(text) + len(regexp_extract_all(text, '[\\x{10000}-\\x{10FFFF}]')))::double end as v, case when text is null then '#VALUE!' end as e from documents")
def fn_len(spark, folder):
    return sheet(spark, folder, "documents").select("doc_id", *T.len_(F.col("text")).columns())


@_query("select c_custkey, left(c_name, 3) as l, right(c_name, 4) as r, c_name||c_mktsegment as c from customer")
def fn_left_right_concat(spark, folder):
    name = F.col("c_name")
    return sheet(spark, folder, "customer").select(
        "c_custkey",
        T.left(name, 3)[0].alias("l"),
        T.right(name, 4)[0].alias("r"),
        T.concat(name, F.col("c_mktsegment"))[0].alias("c"),
    )


# references ------------------------------------------------------------------------------------------------------------


def _orders(spark: SparkSession, folder: str) -> DataFrame:
    return ordered.addressed(sheet(spark, folder, "orders"), "o_orderkey")


_ROW = "row_number() over (order by o_orderkey)"


@_query(f"select o_orderkey, {_ROW} as r, 2 as c, 3 as n_rows, 3 as n_cols from orders")
def ref_row(spark, folder):
    """ROW, COLUMN, ROWS and COLUMNS: the address, and extents that are known before the data."""
    extent = (F.lit(2).alias("c"), F.lit(3).alias("n_rows"), F.lit(3).alias("n_cols"))
    return _orders(spark, folder).select("o_orderkey", F.col("row").alias("r"), *extent)


@_query("select o_orderkey, o_totalprice + (select o_totalprice from orders order by o_orderkey limit 1) as v from orders")
def ref_absolute(spark, folder):
    rows = sheet(spark, folder, "orders")
    first = rows.agg(F.min_by("o_totalprice", "o_orderkey").alias("first"))
    return rows.join(F.broadcast(first)).select("o_orderkey", (F.col("o_totalprice") + F.col("first")).alias("v"))


@_query("select round(sum(x),2) as v from (select c_acctbal x from customer union all select s_acctbal from supplier)")
def ref_sheet_span(spark, folder):
    span = sheet(spark, folder, "customer").select(F.col("c_acctbal").alias("x"))
    span = span.unionByName(sheet(spark, folder, "supplier").select(F.col("s_acctbal").alias("x")))
    return span.agg(F.round(F.sum("x"), 2).alias("v"))


@_query("select 1 as area, c_custkey as k, c_acctbal as v from customer where c_custkey<100 union all select 2, s_suppkey, s_acctbal from supplier where s_suppkey>=50")
def ref_area_union(spark, folder):
    a = sheet(spark, folder, "customer").where("c_custkey < 100").select(F.lit(1).alias("area"), F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    b = sheet(spark, folder, "supplier").where("s_suppkey >= 50").select(F.lit(2).alias("area"), F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"))
    return a.unionByName(b)


@_query("select 'Data' as section, p_partkey as k, p_size::double as a, p_retailprice as b from part union all select 'Totals', null, sum(p_size)::double, round(sum(p_retailprice),2) from part")
def ref_structured(spark, folder):
    """Columns of a table with its totals row: T[[#Data],[#Totals],[a]:[b]]."""
    data = sheet(spark, folder, "part").select(F.lit("Data").alias("section"), F.col("p_partkey").alias("k"), F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b"))
    totals = data.agg(F.lit("Totals").alias("section"), F.lit(None).cast("long").alias("k"), F.sum("a").alias("a"), F.round(F.sum("b"), 2).alias("b"))
    return data.unionByName(totals)


@_query("select o_orderkey, case when o_custkey%3=0 then o_totalprice when o_custkey%3=1 then o_custkey::double end as v, case when o_custkey%3=2 then '#REF!' end as e from orders")
def ref_indirect(spark, folder):
    """A column named by text that the data hold: each name known to the sheet is one branch, an unknown one is #REF!."""
    rows = sheet(spark, folder, "orders").withColumn("name", F.get(F.array(F.lit("price"), F.lit("customer"), F.lit("gone")), F.col("o_custkey").cast("int") % 3))
    names = {"price": F.col("o_totalprice"), "customer": F.col("o_custkey").cast("double")}
    value = F.coalesce(*(F.when(F.col("name") == n, c) for n, c in names.items()))
    return rows.select("o_orderkey", value.alias("v"), F.when(~F.col("name").isin(*names), F.lit("#REF!")).alias("e"))


@_query(f"with o as (select *, {_ROW} r from orders) select a.o_orderkey, b.o_totalprice as v, case when b.r is null then '#REF!' end as e from o a left join o b on b.r = a.r - (a.o_custkey % 5)")
def ref_offset(spark, folder):
    """OFFSET by a number of rows that the data hold: a join on the computed row, #REF! outside the sheet."""
    rows = _orders(spark, folder)
    target = rows.select(F.col("row").alias("at"), F.col("o_totalprice").alias("v"))
    rows = rows.withColumn("to", F.col("row") - F.col("o_custkey") % 5)
    return rows.join(target, F.col("to") == F.col("at"), "left").select(
        "o_orderkey", "v", F.when(F.col("at").isNull(), F.lit("#REF!")).alias("e")
    )


# lookups ---------------------------------------------------------------------------------------------------------------


@_query("select c_custkey, n_name as v, case when n_nationkey is null then '#N/A' end as e from customer left join (select * from nation where n_regionkey<3) on c_nationkey=n_nationkey")
def lookup_vlookup(spark, folder):
    table = sheet(spark, folder, "nation").where("n_regionkey < 3")
    found = lookups.vlookup(sheet(spark, folder, "customer"), F.col("c_nationkey"), table, "n_nationkey", "n_name", "n_nationkey")
    return found.select("c_custkey", "v", "e")


@_query("select c_custkey, pos as v, case when pos is null then '#N/A' end as e from customer left join (select n_regionkey k, min(n_nationkey)+1 pos from nation group by 1) on c_nationkey%7=k")
def lookup_match(spark, folder):
    """The first position wins: regions repeat among the nations, and some keys are in none."""
    table = sheet(spark, folder, "nation").withColumn("row", F.col("n_nationkey") + 1)
    found = lookups.match(sheet(spark, folder, "customer"), F.col("c_nationkey") % 7, table, "n_regionkey", "row")
    return found.select("c_custkey", "v", "e")


@_query("select p_partkey, case p_size%4 when p_size%2 then 1 when p_size%3 then 2 when 3 then 3 end::bigint as v, case when p_size%4 not in (p_size%2, p_size%3, 3) then '#N/A' end as e from part")
def lookup_match_row(spark, folder):
    size = F.col("p_size")
    v, e = lookups.match_in_row(size % 4, [size % 2, size % 3, F.lit(3)])
    return sheet(spark, folder, "part").select("p_partkey", v.alias("v"), e.alias("e"))


@_query(f"with o as (select *, {_ROW} r from orders) select a.o_orderkey, b.o_totalprice as v, case when a.o_custkey%500<1 then '#VALUE!' when b.r is null then '#REF!' end as e from o a left join (select * from o where r<=400) b on b.r=a.o_custkey%500")
def lookup_index(spark, folder):
    rows = _orders(spark, folder)
    table = rows.where("row <= 400").select(F.col("row").alias("at"), F.col("o_totalprice").alias("price"))
    found = lookups.index(rows, F.col("o_custkey") % 500, table, "at", "price", F.lit(400))
    return found.select("o_orderkey", "v", "e")


@_query("select c_custkey, r_name as v from customer join nation on c_nationkey=n_nationkey join region on n_regionkey=r_regionkey")
def lookup_index_match(spark, folder):
    """INDEX(…, MATCH(…)) twice over: customer to nation to region."""
    rows = lookups.vlookup(sheet(spark, folder, "customer"), F.col("c_nationkey"), sheet(spark, folder, "nation"), "n_nationkey", "n_regionkey", "n_nationkey", "region")
    rows = lookups.vlookup(rows, F.col("region"), sheet(spark, folder, "region"), "r_regionkey", "r_name", "r_regionkey")
    return rows.select("c_custkey", "v")


@_query("with p as (select o_orderkey as point, o_custkey as r, (o_totalprice/10000)::bigint as c from orders), q as (select s_suppkey as rect, s_suppkey*10 as t, s_suppkey*10+60 as b, s_nationkey as l, s_nationkey+5 as x from supplier) select point, rect from p join q on r between t and b and c between l and x")
def lookup_range_join(spark, folder):
    """Which rectangles hold a changed cell: the join that finds the formulas over a range. Columns halfway go to the even one."""
    points = sheet(spark, folder, "orders").select(F.col("o_orderkey").alias("point"), F.col("o_custkey").alias("row"), F.rint(F.col("o_totalprice") / 10000).cast("long").alias("col"))
    key = F.col("s_suppkey")
    rects = sheet(spark, folder, "supplier").select(key.alias("rect"), (key * 10).alias("top"), (key * 10 + 60).alias("bottom"), F.col("s_nationkey").alias("left"), (F.col("s_nationkey") + 5).alias("right"))
    return lookups.rects_hit(points, rects, 64)


# aggregates over columns -----------------------------------------------------------------------------------------------


@_query("select cast(null as varchar) as e, round(sum(l_quantity),2) as s, round(sum(l_quantity*l_quantity),2) as q, count(l_quantity)::double as n, round(sum(l_quantity)/count(*),6) as a, min(l_quantity) as lo, max(l_quantity) as hi from lineitem")
def agg_whole_column(spark, folder):
    rows = aggregates.column_aggregates(sheet(spark, folder, "lineitem"), F.col("l_quantity"))
    return rows.select("e", F.round("s", 2).alias("s"), F.round("q", 2).alias("q"), "n", F.round("a", 6).alias("a"), "lo", "hi")


@_query("with c as (select p_partkey, case when p_size%5=0 then '#DIV/0!' when p_partkey=0 then '#NUM!' end as e, p_retailprice as x from part) select min_by(e, p_partkey) filter (e is not null) as e, case when count(e)=0 then sum(x) end as s from c")
def agg_first_error(spark, folder):
    """The error of the least row ends the aggregate: part 0 has size 11 and is #NUM!, later ones are #DIV/0!."""
    err = F.when(F.col("p_size") % 5 == 0, F.lit("#DIV/0!")).when(F.col("p_partkey") == 0, F.lit("#NUM!"))
    return aggregates.column_aggregates(sheet(spark, folder, "part"), F.col("p_retailprice"), err, F.col("p_partkey")).select("e", "s")


@_query("select ['#NULL!','#DIV/0!','#VALUE!','#REF!','#NAME?','#NUM!','#N/A'][min(case when p_size%5=0 then 2 when p_size%5=1 then 7 end)] as e from part")
def agg_dominant_error(spark, folder):
    err = F.when(F.col("p_size") % 5 == 0, F.lit("#DIV/0!")).when(F.col("p_size") % 5 == 1, F.lit("#N/A"))
    return aggregates.dominant_error(sheet(spark, folder, "part"), err)


@_query("select o_orderpriority, round(product(case when o_custkey%2=0 then 1.0001::double else 1/1.0001::double end),6) as v from orders group by 1")
def agg_product(spark, folder):
    """The product over all orders; customers of even and odd keys keep it near 1."""
    factor = F.when(F.col("o_custkey") % 2 == 0, F.lit(1.0001)).otherwise(1 / F.lit(1.0001))
    return sheet(spark, folder, "orders").groupBy("o_orderpriority").agg(F.round(F.product(factor), 6).alias("v"))


@_query("select o_orderpriority, round(product(case when o_orderkey%2=0 then 1.0001::double else 1/1.0001::double end),6) as v from orders group by 1")
def agg_product_all(spark, folder):
    """Over all orders: even keys multiply by what odd ones divide by, so that the product stays near 1 at every size."""
    factor = F.when(F.col("o_orderkey") % 2 == 0, F.lit(1.0001)).otherwise(1 / F.lit(1.0001))
    return sheet(spark, folder, "orders").groupBy("o_orderpriority").agg(F.round(F.product(factor), 6).alias("v"))


_NEAR_ONE = "(case when o_orderkey%4<2 then 1.0001::double else 1/1.0001::double end)"


def _subtotal(code: int, sql: str) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        rows = sheet(spark, folder, "orders")
        filtered, hidden = F.col("o_orderstatus") == "F", F.col("o_custkey") % 2 == 1
        # factors near 1 keep the product of any number of rows finite
        near = F.when(F.col("o_orderkey") % 4 < 2, F.lit(1.0001)).otherwise(1 / F.lit(1.0001))
        num = near if code % 100 == 6 else F.col("o_totalprice") / 1000
        found = aggregates.subtotal(rows, code, num, filtered, hidden)
        return found if exact else found.select(F.round("v", 4).alias("v"))

    # counts, maxima and minima do not depend on the order of adding, so they are compared without rounding
    exact = code % 100 in (2, 3, 4, 5)
    QUERIES[f"agg_subtotal_{code}"] = run
    more = " and o_custkey%2=0" if code > 100 else ""
    ORACLES[f"agg_subtotal_{code}"] = f"select {sql if exact else f'round({sql},4)'} as v from orders where o_orderstatus<>'F'{more}"


_X1000 = "o_totalprice/1000"
for _code, _sql in ((1, f"avg({_X1000})"), (2, f"count({_X1000})::double"), (3, f"count({_X1000})::double"), (4, f"max({_X1000})"), (5, f"min({_X1000})"), (6, f"product({_NEAR_ONE})"), (7, f"stddev_samp({_X1000})"), (8, f"stddev_pop({_X1000})"), (9, f"sum({_X1000})"), (10, f"var_samp({_X1000})"), (11, f"var_pop({_X1000})")):
    _subtotal(_code, _sql)
    _subtotal(100 + _code, _sql)


@_query(f"with o as (select ({_ROW}-1)//1000 as g, o_totalprice p from orders), a as (select g, sum(p) v from o group by 1) select 1 as level, g, round(v,2) as v from a union all select 2, g//10, round(sum(v),2) from a group by g//10")
def agg_sum_pyramid(spark, folder):
    found = aggregates.pyramid(_orders(spark, folder), "row", F.col("o_totalprice"), (1000, 10))
    return found.withColumn("v", F.round("v", 2))


@_query("select round(sum(o_totalprice),2) as v from orders")
def agg_compensated_sum(spark, folder):
    found = aggregates.compensated_sum(_orders(spark, folder), "row", F.col("o_totalprice"))
    return found.select(F.round("v", 2).alias("v"))


# row-offset references -------------------------------------------------------------------------------------------------


@_query("select o_orderkey, round(v,2) as v from (select o_orderkey, row_number() over w r, sum(o_totalprice) over (order by o_orderkey rows 2 preceding) v from orders window w as (order by o_orderkey)) where r>=3")
def win_sum_moving(spark, folder):
    """SUM(R[-2]C[-1]:RC[-1]) from row 3: above it the range would leave the sheet."""
    w = ordered.frame().rowsBetween(-2, 0)
    rows = ordered.offset_frames(_orders(spark, folder), 2, {"v": F.sum("o_totalprice").over(w)}, rows=4096)
    return rows.where("row >= 3").select("o_orderkey", F.round("v", 2).alias("v"))


@_query("select o_orderkey, v from (select o_orderkey, o_totalprice-lag(o_totalprice) over (order by o_orderkey) v from orders) where v is not null")
def win_lag_ref(spark, folder):
    before = F.lag("o_totalprice").over(ordered.frame())
    rows = ordered.offset_frames(_orders(spark, folder), 1, {"v": F.col("o_totalprice") - before}, rows=4096)
    return rows.where("row >= 2").select("o_orderkey", "v")


@_query("select o_orderkey, (sum(round(o_totalprice*100)::bigint) over (order by o_orderkey))::bigint as v from orders")
def win_running_sum(spark, folder):
    """SUM(R1C1:RC1), in whole cents."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    return ordered.running_sum(sheet(spark, folder, "orders"), "o_orderkey", cents, "v").select("o_orderkey", "v")


@_query("select o_orderkey, cast(row_number() over (order by o_orderkey) as double) as v from orders")
def recur_fill_down(spark, folder):
    """=R[-1]C+1 from a seed of 1: a linear recurrence is a running sum."""
    rows = ordered.running_sum(sheet(spark, folder, "orders"), "o_orderkey", F.lit(1.0), "v")
    return rows.select("o_orderkey", "v")


@_query("with b as (select o_orderkey k, 1.0::double c1, row_number() over (order by o_orderkey) r from orders), x as (select *, 1 + sum(case when r>1 then c1 else 0 end) over (order by r) c2 from b) select k as o_orderkey, c2, 1 + sum(case when r>1 then c2 else 0 end) over (order by r) as c3 from x")
def recur_pascal(spark, folder):
    """=RC[-1]+R[-1]C with seeds of 1 in the first row and column: each column is a running sum of the one before."""
    rows = ordered.in_blocks(sheet(spark, folder, "orders").select("o_orderkey"), "o_orderkey")
    rows = ordered.numbered(rows, "o_orderkey").withColumn("c1", F.lit(1.0))
    for k in (2, 3):
        step = F.when(F.col("row") > 1, F.col(f"c{k - 1}")).otherwise(0.0)
        rows = ordered.scan(rows, ["o_orderkey"], f"c{k}", F.sum, step).withColumn(f"c{k}", F.col(f"c{k}") + 1)
    return rows.select("o_orderkey", "c2", "c3")


# viewports, spills, edits ----------------------------------------------------------------------------------------------


@_query(f"select * from (select {_ROW} as r, o_orderkey, o_totalprice*2 as v from orders) where r between 101 and 740")
def view_tile(spark, folder):
    rows = ordered.rows_at(sheet(spark, folder, "orders"), "o_orderkey", first=101, last=740)
    return rows.select(F.col("row").alias("r"), "o_orderkey", (F.col("o_totalprice") * 2).alias("v"))


@_query("select c_custkey, c_acctbal as v from customer where c_custkey in (select s_suppkey*7 from supplier)")
def view_sampled(spark, folder):
    probes = sheet(spark, folder, "supplier").select((F.col("s_suppkey") * 7).alias("c_custkey"))
    return sheet(spark, folder, "customer").join(probes, "c_custkey", "left_semi").select("c_custkey", F.col("c_acctbal").alias("v"))


@_query("select c_custkey, c_acctbal, rank() over (order by c_acctbal desc) as place, c_acctbal > (select avg(c_acctbal)+stddev_pop(c_acctbal) from customer) as above from customer qualify place <= 50")
def format_rank_average(spark, folder):
    """Conditional formats: the top 50, and which of them lie a standard deviation above the average."""
    rows = sheet(spark, folder, "customer")
    top = rows.orderBy(F.desc("c_acctbal")).limit(50).agg(F.min("c_acctbal").alias("bar"))
    level = rows.agg((F.avg("c_acctbal") + F.stddev_pop("c_acctbal")).alias("level"))
    marked = rows.join(F.broadcast(top), F.col("c_acctbal") >= F.col("bar")).join(F.broadcast(level))
    place = F.rank().over(W.orderBy(F.desc("c_acctbal")))
    return marked.select("c_custkey", "c_acctbal", place.cast("long").alias("place"), (F.col("c_acctbal") > F.col("level")).alias("above"))


@_query("select row_number() over (order by o_orderkey) as r, o_orderkey, o_totalprice from orders where o_totalprice>200000")
def spill_filter(spark, folder):
    """FILTER: the kept rows, numbered anew from the anchor."""
    kept = sheet(spark, folder, "orders").where("o_totalprice > 200000")
    return ordered.addressed(kept, "o_orderkey", name="r").select("r", "o_orderkey", "o_totalprice")


@_query("select range::double as v from range(1, (select count(*)+1 from orders))")
def spill_sequence(spark, folder):
    """SEQUENCE(COUNT(A:A))."""
    return spark.range(1, sheet(spark, folder, "orders").count() + 1).select(F.col("id").cast("double").alias("v"))


def _extents(spark: SparkSession, folder: str) -> DataFrame:
    """An array at each part: anchors down one column 6 rows apart, as many rows as its size leaves in 8."""
    top = F.col("p_partkey") * 6 + 1
    return sheet(spark, folder, "part").select(
        F.col("p_partkey").alias("anchor"), top.alias("top"), F.lit(1).cast("long").alias("left"), (top + F.col("p_size") % 8).alias("bottom"), F.lit(1).cast("long").alias("right")
    )


@_query("with x as (select p_partkey as anchor, p_partkey*6+1 as t, p_partkey*6+1+p_size%8 as b from part) select anchor, exists(select 1 from x y where y.anchor<>x.anchor and y.anchor between x.anchor-2 and x.anchor+2 and y.t<=x.b and x.t<=y.b) or t <= 13 and 13 <= b as blocked from x")
def spill_blocked(spark, folder):
    """Arrays that meet each other, or a written cell in row 13, are blocked, both of a pair."""
    cell = spark.range(1).select(F.lit(None).cast("long").alias("owner"), *(F.lit(v).cast("long").alias(c) for c, v in (("top", 13), ("left", 1), ("bottom", 13), ("right", 1))))
    return spills.arbitrated(_extents(spark, folder), cell).select("anchor", "blocked")


@_query("with x as (select p_partkey as anchor, p_partkey*6+1 as t, p_size%8 as n from part), y as (select a.*, exists(select 1 from x z where z.anchor<>a.anchor and z.anchor between a.anchor-2 and a.anchor+2 and z.t<=a.t+a.n and a.t<=z.t+z.n) as blocked from x a) select anchor, t+i as row, 1 as col, i::double as v, cast(null as varchar) as e from y, lateral (select unnest(range(0, n+1)) as i) where not blocked union all select anchor, t, 1, null, '#SPILL!' from y where blocked")
def spill_published(spark, folder):
    extents = _extents(spark, folder)
    none = extents.limit(0).select(F.col("anchor").alias("owner"), "top", "left", "bottom", "right")
    values = extents.select("anchor", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bottom") - F.col("top"))).alias("i"))
    values = values.select("anchor", "i", F.lit(0).alias("j"), F.col("i").cast("double").alias("v"))
    return spills.published(spills.arbitrated(extents, none), values)


@_query("select p_partkey as anchor, (p_size%8)::int as rows, p_size%3=0 as blocked, p_partkey%10 as digest, 1 + (case when p_partkey%4=0 or p_partkey is null then 1 else 0 end) as epoch from part")
def spill_epochs(spark, folder):
    """A recalculation that gives every fourth spill another value raises the epoch of just those."""
    now = sheet(spark, folder, "part").select(F.col("p_partkey").alias("anchor"), (F.col("p_size") % 8).alias("rows"), (F.col("p_size") % 3 == 0).alias("blocked"), (F.col("p_partkey") % 10).alias("digest"))
    before = now.withColumn("digest", F.when(F.col("anchor") % 4 == 0, -1).otherwise(F.col("digest"))).withColumn("epoch", F.lit(1))
    return spills.epochs(before, now)


@_query(f"select case when r>=3 then r+1 else r end as r, o_totalprice from (select {_ROW} r, o_totalprice from orders)")
def edit_insert_row(spark, folder):
    return edits.insert_rows(_orders(spark, folder), "row", 3, 1).select(F.col("row").alias("r"), "o_totalprice")


@_query(f"select case when r>=15 then r-5 else r end as r, o_totalprice from (select {_ROW} r, o_totalprice from orders) where r not between 10 and 14")
def edit_delete_rows(spark, folder):
    return edits.delete_rows(_orders(spark, folder), "row", 10, 5).select(F.col("row").alias("r"), "o_totalprice")


@_query("select s_suppkey, case when s_suppkey<40 or s_suppkey>=60 or s_nationkey+s_suppkey>=60 then case when s_suppkey>=60 then s_suppkey-20 when s_suppkey>=40 then 40 else s_suppkey end end as t, case when s_suppkey<40 or s_suppkey>=60 or s_nationkey+s_suppkey>=60 then case when s_suppkey+s_nationkey>=60 then s_suppkey+s_nationkey-20 when s_suppkey+s_nationkey>=40 then 39 else s_suppkey+s_nationkey end end as b, case when s_suppkey>=40 and s_suppkey+s_nationkey<=59 then 'Deleted' when s_suppkey+s_nationkey<40 then 'Unchanged' when s_suppkey>59 then 'Shifted' else 'Shrunk' end as outcome from supplier")
def edit_range_delete(spark, folder):
    top, bottom = F.col("s_suppkey"), F.col("s_suppkey") + F.col("s_nationkey")
    t, b, outcome = edits.range_after_delete(top, bottom, 40, 20)
    return sheet(spark, folder, "supplier").select("s_suppkey", t.alias("t"), b.alias("b"), outcome.alias("outcome"))


@_query("select s_suppkey, case when s_suppkey>=50 then s_suppkey+5 else s_suppkey end as t, case when s_suppkey+s_nationkey>=50 then s_suppkey+s_nationkey+5 else s_suppkey+s_nationkey end as b, case when s_suppkey>=50 then 'Shifted' when s_suppkey+s_nationkey>=50 then 'Expanded' else 'Unchanged' end as outcome from supplier")
def edit_range_insert(spark, folder):
    top, bottom = F.col("s_suppkey"), F.col("s_suppkey") + F.col("s_nationkey")
    t, b, outcome = edits.range_after_insert(top, bottom, 50, 5, spills.MAX_ROWS)
    return sheet(spark, folder, "supplier").select("s_suppkey", t.alias("t"), b.alias("b"), outcome.alias("outcome"))


@_query("select o_orderkey, case when o_custkey=7 then -1.0 else o_totalprice end as o_totalprice from orders where o_custkey<>8")
def edit_write_clear(spark, folder):
    """Written cells over a sheet, then cells cleared."""
    rows = sheet(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_custkey")
    written = rows.where("o_custkey = 7").select("o_orderkey", F.lit(-1.0).alias("o_totalprice"))
    rows = edits.overlaid(rows, "o_orderkey", written, "o_totalprice")
    return edits.cleared(rows, "o_orderkey", rows.where("o_custkey = 8")).select("o_orderkey", "o_totalprice")


@_query("select o_orderkey, case when o_custkey=7 then 'changed' when o_custkey=8 then 'cleared' else 'set' end as change, case when o_custkey in (7,8) then o_totalprice end as old, case o_custkey when 7 then o_totalprice*2 when 9 then o_totalprice end as new from orders where o_custkey in (7,8,9)")
def delta_authored(spark, folder):
    rows = sheet(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_custkey")
    old = rows.where("o_custkey != 9")
    new = rows.where("o_custkey != 8").withColumn("o_totalprice", F.when(F.col("o_custkey") == 7, F.col("o_totalprice") * 2).otherwise(F.col("o_totalprice")))
    found = edits.delta(old, new, "o_orderkey", ["o_totalprice"])
    return found.select("o_orderkey", "change", F.col("old_o_totalprice").alias("old"), F.col("new_o_totalprice").alias("new"))


# trees -----------------------------------------------------------------------------------------------------------------


def _tree(spark: SparkSession, folder: str) -> DataFrame:
    """region, nation and customer as one tree under a root: (node, parent, ord, value)."""
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    none = F.lit(None).cast("double")
    root = spark.range(1).select(F.lit("root").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("ord"), none.alias("value"))
    regions = sheet(spark, folder, "region").select(key("r", "r_regionkey").alias("node"), F.lit("root").alias("parent"), F.col("r_regionkey").cast("long").alias("ord"), none.alias("value"))
    nations = sheet(spark, folder, "nation").select(key("n", "n_nationkey").alias("node"), key("r", "n_regionkey").alias("parent"), F.col("n_nationkey").cast("long").alias("ord"), none.alias("value"))
    customers = sheet(spark, folder, "customer").select(key("c", "c_custkey").alias("node"), key("n", "c_nationkey").alias("parent"), F.col("c_custkey").alias("ord"), F.col("c_acctbal").alias("value"))
    return root.unionByName(regions).unionByName(nations).unionByName(customers)


@_query("select 'n'||c_nationkey as node, round(sum(c_acctbal),2) as v from customer group by 1")
def tree_children_sum(spark, folder):
    nodes = _tree(spark, folder)
    own = nodes.where("value is not null").select(F.col("node").alias("child"), "value")
    return trees.children(nodes).join(own, "child").groupBy("node").agg(F.round(F.sum("value"), 2).alias("v"))


@_query("select 'c'||c_custkey as node, round(coalesce(sum(c_acctbal) over (partition by c_nationkey order by c_custkey rows between unbounded preceding and 1 preceding),0),2) as before, round(coalesce(sum(c_acctbal) over (partition by c_nationkey order by c_custkey rows between 1 following and unbounded following),0),2) as after from customer")
def tree_siblings(spark, folder):
    leaves = _tree(spark, folder).where("value is not null")
    both = trees.preceding(leaves, "value", "before").join(trees.following(leaves, "value", "after"), "node")
    return both.select("node", F.round("before", 2).alias("before"), F.round("after", 2).alias("after"))


@_query("select 'c'||c_custkey as node, 'n'||c_nationkey as ancestor, 1 as distance from customer union all select 'c'||c_custkey, 'r'||n_regionkey, 2 from customer join nation on c_nationkey=n_nationkey")
def tree_ancestors(spark, folder):
    nodes = _tree(spark, folder)
    return trees.ancestors(nodes, nodes.where("value is not null"))


@_query("select 'r'||n_regionkey as node, 'n'||n_nationkey as descendant from nation union all select 'r'||n_regionkey, 'c'||c_custkey from customer join nation on c_nationkey=n_nationkey")
def tree_descendants(spark, folder):
    nodes = _tree(spark, folder)
    return trees.descendants(nodes, nodes.where("parent = 'root'")).select("node", "descendant")


# dependencies ----------------------------------------------------------------------------------------------------------


@_query("with recursive e as (select c_custkey as source, c_custkey//3 as target from customer where c_custkey//3<>c_custkey), r(node, depth) as (select c_custkey, 0 from customer where c_custkey%500=7 union all select target, depth+1 from r join e on source=node) select node, min(depth) as depth from r group by 1")
def dependency_closure(spark, folder):
    """What a change of some cells makes dirty, by the steps it takes to reach them."""
    rows = sheet(spark, folder, "customer")
    edges = rows.select(F.col("c_custkey").alias("source"), F.expr("c_custkey div 3").alias("target")).where("source != target")
    return graph.closure(edges, rows.where("c_custkey % 500 = 7").select(F.col("c_custkey").alias("node")))


@_query('select s_suppkey as node, (s_suppkey//10)*10 as "group" from supplier where s_suppkey%10<3 and (s_suppkey//10)*10+2 <= (select max(s_suppkey) from supplier)')
def dependency_cycles(spark, folder):
    """Of each ten suppliers the first three refer to each other in a ring, the rest in a chain to them."""
    k = F.col("s_suppkey")
    target = F.when(k % 10 < 2, k + 1).when(k % 10 == 2, k - 2).otherwise(k - 1)
    return graph.cycle_groups(sheet(spark, folder, "supplier").select(k.alias("source"), target.alias("target")))


@_query("select n_nationkey as node, round(2.0*n_nationkey,2) as value from nation")
def dependency_jacobi(spark, folder):
    """Each cell refers to itself at half weight: value = key + value / 2 settles at twice the key."""
    cells = sheet(spark, folder, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_nationkey").cast("double").alias("base"), F.lit(0.0).alias("value"))
    links = cells.select(F.col("node").alias("source"), F.col("node").alias("target"), F.lit(0.5).alias("weight"))
    return graph.jacobi(cells, links, change=1e-4).select("node", F.round("value", 2).alias("value"))


@_query("select s_suppkey as node, round(2.0*s_suppkey,2) as value from supplier")
def dependency_jacobi_all(spark, folder):
    """The same over all suppliers."""
    cells = sheet(spark, folder, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_suppkey").cast("double").alias("base"), F.lit(0.0).alias("value"))
    links = cells.select(F.col("node").alias("source"), F.col("node").alias("target"), F.lit(0.5).alias("weight"))
    return graph.jacobi(cells, links, change=1e-4).select("node", F.round("value", 2).alias("value"))


# streams ---------------------------------------------------------------------------------------------------------------


def _updates(spark: SparkSession, folder: str) -> DataFrame:
    return sheet(spark, folder, "events").select(
        F.col("event_type").alias("topic_id"), F.col("user_id").alias("topic_sequence"), F.col("props").alias("payload_ref"), F.col("event_id").alias("ordering_key"), (F.col("user_id") * 7 + F.col("event_id") % 11).cast("string").alias("dedupe_identity")
    )


_STREAM = "with a as (select *, row_number() over (partition by user_id*7+event_id%11 order by event_id) rn from events), b as (select * from a where rn=1), d as (select *, max(user_id) over (partition by event_type order by event_id rows between unbounded preceding and 1 preceding) m from b), x as (select * from d where user_id>=coalesce(m,user_id)) "


@_query(_STREAM + "select event_id, event_type, user_id from x")
def stream_accepted(spark, folder):
    found = topics.accepted(_updates(spark, folder))
    return found.select(F.col("ordering_key").alias("event_id"), F.col("topic_id").alias("event_type"), F.col("topic_sequence").alias("user_id"))


@_query(_STREAM + "select event_type, max_by(user_id, event_id) as user_id, max(event_id) as event_id from x group by 1")
def stream_current(spark, folder):
    found = topics.current(_updates(spark, folder))
    return found.select(F.col("topic_id").alias("event_type"), F.col("topic_sequence").alias("user_id"), F.col("ordering_key").alias("event_id"))


@_query(_STREAM + "select distinct n_nationkey as node from x join nation on length(event_type)%5=n_regionkey")
def stream_seeds(spark, folder):
    names = sheet(spark, folder, "events").select(F.col("event_type").alias("topic_id")).distinct()
    nation = sheet(spark, folder, "nation").select(F.col("n_nationkey").alias("node"), "n_regionkey")
    subscriptions = names.join(nation, F.length("topic_id") % 5 == F.col("n_regionkey")).select("topic_id", "node")
    return topics.seeds(_updates(spark, folder), subscriptions)


# errors as codes -------------------------------------------------------------------------------------------------------


@_query("select p_partkey, [0,7,15,23,29,36,42][p_size%7+1] as code, ['#NULL!','#DIV/0!','#VALUE!','#REF!','#NAME?','#NUM!','#N/A'][p_size%7+1] as back from part")
def error_codes(spark, folder):
    err = C.error_of_rank(F.col("p_size") % 7)
    code = C.error_code(err)
    return sheet(spark, folder, "part").select("p_partkey", code.alias("code"), C.error_of_code(code).alias("back"))


@_query("select event_id, epoch_us(ts)/86400000000.0 + 25569 as serial from events")
def date_serial(spark, folder):
    """Times as serial numbers of the 1900 system."""
    return sheet(spark, folder, "events").select("event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(86400e6) + 25569).alias("serial"))


# workbooks, names, recalculation ---------------------------------------------------------------------------------------


def _workbook(spark: SparkSession, folder: str) -> Workbook:
    customers = sheet(spark, folder, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    suppliers = sheet(spark, folder, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"))
    parts = sheet(spark, folder, "part").select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("v"))
    book = Workbook({"Customers": customers, "Suppliers": suppliers, "Parts": parts})
    book.define("Input", lambda b: b.sheet("customers").where("k < 100"))
    book.define("Input", lambda b: b.sheet("suppliers").where("k < 50"), scope="Suppliers")
    return book


@_query("select 'Customers' as place, round(sum(c_acctbal),2) as v from customer where c_custkey<100 union all select 'Suppliers', round(sum(s_acctbal),2) from supplier where s_suppkey<50")
def ref_defined_name(spark, folder):
    """=SUM(Input) on two sheets: one has a name of its own, the other sees the workbook's."""
    book = _workbook(spark, folder)
    total = lambda place: book.resolve("INPUT", place).agg(F.lit(place).alias("place"), F.round(F.sum("v"), 2).alias("v"))
    return total("Customers").unionByName(total("Suppliers"))


@_query("select 'Customers' as place, round(sum(c_acctbal),2) as v from customer union all select 'Suppliers', round(sum(s_acctbal),2) from supplier")
def ref_defined_name_all(spark, folder):
    """The same where the names are whole sheets."""
    book = _workbook(spark, folder)
    book.define("Column", lambda b: b.sheet("customers"))
    book.define("Column", lambda b: b.sheet("suppliers"), scope="Suppliers")
    total = lambda place: book.resolve("COLUMN", place).agg(F.lit(place).alias("place"), F.round(F.sum("v"), 2).alias("v"))
    return total("Customers").unionByName(total("Suppliers"))


@_query("select round(sum(v),2) as v, count(*) as n from (select s_acctbal v from supplier union all select p_retailprice from part)")
def ref_workbook_span(spark, folder):
    found = _workbook(spark, folder).span("Parts", "Suppliers", ["k", "v"])
    return found.agg(F.round(F.sum("v"), 2).alias("v"), F.count("v").alias("n"))


@_query("select c_custkey as k, c_acctbal as v, 'csv' as kind from customer union all select c_custkey, c_acctbal, 'json' from customer union all select c_custkey, c_acctbal, 'orc' from customer")
def sink_formats(spark, folder):
    """A sheet saved as CSV, JSON and ORC and read back."""
    book = Workbook({"Customers": _workbook(spark, folder).sheet("Customers")})
    found = None
    for kind in ("csv", "json", "orc"):
        place = f"{shared_dir(spark)}/workbook-{kind}-{uuid.uuid4().hex}"
        book.save(place, kind)
        back = Workbook.load(spark, place, {"Customers": "k long, v double"}, kind).sheet("Customers").withColumn("kind", F.lit(kind))
        found = back if found is None else found.unionByName(back)
    return found


@_query("select event_type, count(*) as n from events where event_type not in ('click','view','purchase') group by 1")
def source_unaccounted(spark, folder):
    ledger = spark.range(1).select(F.explode(F.array(*map(F.lit, ("click", "view", "purchase")))).alias("event_type"))
    return unaccounted(sheet(spark, folder, "events"), ledger, "event_type")


@_query("select p_partkey, case when p_size%7=0 then p_retailprice else p_retailprice*2 end as v, cast(null as varchar) as e, case when p_size%7=0 then 'Degraded' else 'Calculated' end as provenance from part")
def source_provenance(spark, folder):
    rows = sheet(spark, folder, "part")
    unread = F.col("p_size") % 7 == 0
    made = rows.select("p_partkey", F.when(~unread, F.col("p_retailprice") * 2).alias("v"), F.when(unread, "#NAME?").alias("e"))
    return with_cached(made, rows.select("p_partkey", F.col("p_retailprice").alias("v")), "p_partkey")


@_query("select o_orderkey, case when o_custkey=7 then o_totalprice*3 else o_totalprice*2 end as v from orders")
def recalc_dirty_rows(spark, folder):
    """Inputs of a few rows change; only those rows are worked out anew, the rest keep their published values."""
    rows = sheet(spark, folder, "orders")
    old = rows.select("o_orderkey", (F.col("o_totalprice") * 2).alias("v"))
    inputs = rows.withColumn("factor", F.when(F.col("o_custkey") == 7, 3).otherwise(2))
    return edits.recalculated(old, inputs, rows.where("o_custkey = 7"), "o_orderkey", F.col("o_totalprice") * F.col("factor"), "v")


@_query("select p_partkey from part where p_size%5=0 and p_size%2=1")
def recalc_early_cutoff(spark, folder):
    """Of the cells worked out anew only those with another value go on: INT(x/2) hides a rise of an even x by one."""
    rows = sheet(spark, folder, "part")
    old = rows.select("p_partkey", F.floor(F.col("p_size") / 2).alias("v"))
    new = rows.where("p_size % 5 = 0").select("p_partkey", F.floor((F.col("p_size") + 1) / 2).alias("v"))
    return edits.really_changed(old, new, "p_partkey", "v")


@_query("select 'added' as change, c_custkey as source, c_nationkey+1 as target from customer where c_custkey%100=3 union all select 'removed', c_custkey, c_nationkey from customer where c_custkey%100=3")
def delta_edges(spark, folder):
    """Dependencies that a rebind added and removed."""
    old = sheet(spark, folder, "customer").select(F.col("c_custkey").alias("source"), F.col("c_nationkey").alias("target"))
    new = old.withColumn("target", F.col("target") + F.when(F.col("source") % 100 == 3, 1).otherwise(0))
    added = new.exceptAll(old).select(F.lit("added").alias("change"), "source", "target")
    return added.unionByName(old.exceptAll(new).select(F.lit("removed").alias("change"), "source", "target"))


@_query("select 'n'||n_nationkey as node, case when n_nationkey=0 then 'r4' else 'r'||n_regionkey end as parent, (case when n_nationkey=0 then 10 when n_regionkey=4 and n_nationkey>=10 then n_nationkey+1 else n_nationkey end)::bigint as ord from nation")
def edit_tree_move(spark, folder):
    """Nation 0 moves under region 4, to place 10."""
    nodes = _tree(spark, folder).where("node like 'n%'").select("node", "parent", "ord")
    return edits.moved(nodes, "n0", "r4", 10)


@_query("select 'c'||c_custkey as node, case when c_custkey=7 then 'n4' else 'n'||c_nationkey end as parent, (case when c_custkey=7 then 10 when c_nationkey=4 and c_custkey>=10 then c_custkey+1 else c_custkey end)::bigint as ord from customer")
def edit_tree_move_all(spark, folder):
    """Among all customers, customer 7 moves under nation 4, to place 10."""
    nodes = _tree(spark, folder).where("node like 'c%'").select("node", "parent", "ord")
    return edits.moved(nodes, "c7", "n4", 10)


@_query("select 'n'||n_nationkey as node, round(sum(c_acctbal),2) as v from nation join customer on c_nationkey=n_nationkey where c_mktsegment='BUILDING' group by 1")
def tree_selector_tail(spark, folder):
    """=SUM(children.BUILDING): members of one name under each node; nodes without one drop out."""
    names = sheet(spark, folder, "customer").where("c_mktsegment = 'BUILDING'")
    tail = names.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("child"), F.col("c_acctbal").alias("value"))
    found = trees.children(_tree(spark, folder)).join(tail, "child")
    return found.groupBy("node").agg(F.round(F.sum("value"), 2).alias("v"))


@_query("select case when t=1 then 'low' when t=2 then 'mid' else 'high' end as icon, count(*) as n from (select case when c_acctbal < (select quantile_cont(c_acctbal,0.33) from customer) then 1 when c_acctbal < (select quantile_cont(c_acctbal,0.67) from customer) then 2 else 3 end as t from customer) group by 1")
def format_icons(spark, folder):
    """An icon set by percentiles of the column."""
    rows = sheet(spark, folder, "customer")
    low, high = ordered.quantiles(rows, "c_acctbal", [0.33, 0.67])
    icon = F.when(F.col("c_acctbal") < low, "low").when(F.col("c_acctbal") < high, "mid").otherwise("high")
    return rows.groupBy(icon.alias("icon")).agg(F.count(F.lit(1)).alias("n"))


@_query("select p_partkey, (c_acctbal-lo)/(hi-lo) as v from (select p_partkey, p_retailprice as c_acctbal, min(p_retailprice) over () lo, max(p_retailprice) over () hi from part)")
def format_color_scale(spark, folder):
    """The place of each number between the column's minimum and maximum."""
    rows = sheet(spark, folder, "part")
    ends = rows.agg(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"))
    place = (F.col("p_retailprice") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    return rows.join(F.broadcast(ends)).select("p_partkey", place.alias("v"))


@_query("select sum(o_orderkey)::bigint as v, count(*) as n from orders where o_totalprice>200000")
def spill_ref_sum(spark, folder):
    """=SUM(A1#) over the spill of a FILTER."""
    return spill_filter(spark, folder).agg(F.sum("o_orderkey").alias("v"), F.count("r").alias("n"))


@_query("select o_orderkey, o_totalprice from orders where o_custkey%10=3")
def spill_filter_columns(spark, folder):
    """FILTER by a row of flags keeps columns, by a column of flags keeps rows."""
    rows = sheet(spark, folder, "orders")
    flags = {"o_orderkey": True, "o_custkey": False, "o_orderstatus": False, "o_totalprice": True, "o_orderdate": False, "o_orderpriority": False}
    return rows.where("o_custkey % 10 = 3").select(*(c for c in rows.columns if flags[c]))


def _wrapped(x: str) -> str:
    return f"(({x}) % 18446744073709551616::uhugeint)"


def _mixed(x: str) -> str:
    """SplitMix64's finish, on 128-bit numbers that are cut to 64 bits."""
    a = _wrapped(f"xor({x}, {x} // 1073741824::uhugeint) * 13787848793156543929::uhugeint")
    b = f"(select {_wrapped('xor(y, y // 134217728::uhugeint) * 10723151780598845931::uhugeint')} from (select {a} as y))"
    return f"(select xor(z, z // 2147483648::uhugeint) from (select {b} as z))"


_FNV = "list_reduce(list_transform(string_split('customer!'||c_custkey, ''), lambda x: ord(x)::uhugeint), lambda h, x: (xor(h, x) * 1099511628211::uhugeint) % 18446744073709551616::uhugeint, 14695981039346656037::uhugeint)"


@_query(f"with k as (select c_custkey, {_FNV} as f from customer), s as (select c_custkey, {_mixed('42::uhugeint')} as a, {_mixed('f')} as b from k), t as (select c_custkey, {_wrapped('xor(a, b) + 11400714819323198485::uhugeint')} as n from s), u as (select c_custkey, {_mixed('n')} as m from t) select c_custkey, (m // 2048::uhugeint)::double / 9007199254740992 as v from u")
def fn_rand(spark, folder):
    """RAND() of each customer's cell: the same number in every run and partitioning."""
    rows = sheet(spark, folder, "customer")
    return rows.select("c_custkey", rand(F.concat(F.lit("customer!"), F.col("c_custkey").cast("string")), 42).alias("v"))

