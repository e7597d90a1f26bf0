"""Further registered queries over the given tables: references, lookups with errors, edits of catalogs, spills, graphs, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomsheet.functions.volatile import Tick
from loomsheet.operators import aggregates, edits, lookups, references, spills, trees
from loomsheet.operators.tables import Table, edited, rewritten
from loomsheet.plans import graph, ordered
from loomsheet.plans.cone import cone
from loomsheet.queries import _ROW, _query, _tree
from loomsheet.sources.tables import sheet
from loomsheet.sources.workbook import Workbook
from loomsheet.streaming import topics

# lookups ---------------------------------------------------------------------------------------------------------------

_ERRORS_IN_NATIONS = "select n_nationkey+1 as r, n_nationkey as k, case when n_nationkey=20 then '#DIV/0!' end as ke, n_regionkey as region from nation"


def _nations(spark, folder):
    key = F.col("n_nationkey")
    return sheet(spark, folder, "nation").select((key + 1).alias("r"), key.alias("k"), F.when(key == 20, "#DIV/0!").alias("ke"), F.col("n_regionkey").alias("region"))


@_query(f"with n as ({_ERRORS_IN_NATIONS}), x as (select c_custkey, c_nationkey + 5*(c_custkey%2) as x, c_custkey%4 as k, case when c_custkey%11=0 then '#NUM!' end as xe from customer), y as (select x.*, n.r, n.region from x left join (select * from n where ke is null) n on x.x=n.k), z as (select *, case when k<1 then '#VALUE!' when k>2 then '#REF!' when xe is not null then xe when coalesce(r, 1000)>21 then '#DIV/0!' end as e from y) select c_custkey, case when e is null then case k when 1 then x else region end::double end as v, e from z")
def lookup_vlookup_column(spark, folder):
    """The column is data: out of range before an error in the key, an error in the key column before the hit."""
    rows = sheet(spark, folder, "customer").select("c_custkey", (F.col("c_nationkey") + 5 * (F.col("c_custkey") % 2)).alias("x"))
    xe = F.when(F.col("c_custkey") % 11 == 0, F.lit("#NUM!"))
    found = lookups.vlookup_column(rows, F.col("x"), xe, F.col("c_custkey") % 4 + 0.5, _nations(spark, folder), "k", "ke", "r", ["k", "region"])
    return found.select("c_custkey", "v", "e")


@_query(f"with n as ({_ERRORS_IN_NATIONS}), m as (select region, min(r) as r from n where ke is null group by 1) select c_custkey, case when c_custkey%11<>0 and r is not null then r::double end as v, case when c_custkey%11=0 then '#NUM!' when r is null then '#DIV/0!' end as e from customer left join m on region=c_nationkey%7")
def lookup_match_errors(spark, folder):
    """A miss meets the error in the column; hits lie before it."""
    xe = F.when(F.col("c_custkey") % 11 == 0, F.lit("#NUM!"))
    found = lookups.match_area(sheet(spark, folder, "customer"), F.col("c_nationkey") % 7, xe, _nations(spark, folder), "region", "ke", "r")
    return found.select("c_custkey", "v", "e")


@_query("select c_custkey, cast(null as double) as v, case when c_custkey%11=0 then '#NUM!' else '#VALUE!' end as e from customer")
def lookup_match_area(spark, folder):
    """MATCH takes one row or one column; an area is #VALUE!."""
    xe = F.when(F.col("c_custkey") % 11 == 0, F.lit("#NUM!"))
    found = lookups.match_area(sheet(spark, folder, "customer"), F.col("c_nationkey"), xe, _nations(spark, folder), "k", "ke", "r", width=2)
    return found.select("c_custkey", "v", "e")


@_query("with s as (select row_number() over (order by s_suppkey) as r, s_suppkey::double a, s_nationkey::double b, s_acctbal c from supplier), x as (select o_orderkey, o_custkey%150 as r, o_orderkey%5 as k from orders) select o_orderkey, case k when 1 then a when 2 then b when 3 then c end as v, case when x.r<1 or k<1 then '#VALUE!' when x.r>(select count(*) from s) or k>3 then '#REF!' end as e from x left join s on s.r=x.r and x.r>=1 and k between 1 and 3")
def lookup_index_area(spark, folder):
    """INDEX over the suppliers with row and column from the data."""
    table = ordered.addressed(sheet(spark, folder, "supplier"), "s_suppkey")
    rows = sheet(spark, folder, "orders").select("o_orderkey", (F.col("o_custkey") % 150).alias("r"), (F.col("o_orderkey") % 5).alias("k"))
    found = lookups.index_area(rows, F.col("r"), F.col("k") + 0.25, table, "row", ["s_suppkey", "s_nationkey", "s_acctbal"], table.count())
    return found.select("o_orderkey", "v", "e")


# references ------------------------------------------------------------------------------------------------------------


def _cells(spark, folder):
    """Two sheets in long form: suppliers in A to C, parts in A to B, rows by key from 1; every seventh price is an error."""
    def long(sheet_name, rows, key, columns):
        cells = F.array(*(F.struct(F.lit(i).cast("long").alias("col"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns, 1)))
        return rows.select(F.lit(sheet_name).alias("sheet"), (F.col(key) + 1).cast("long").alias("row"), F.inline(cells), F.col("bad").alias("bad"))

    none = F.lit(None).cast("string")
    suppliers = long("Suppliers", sheet(spark, folder, "supplier").withColumn("bad", none), "s_suppkey", ["s_suppkey", "s_nationkey", "s_acctbal"])
    parts = sheet(spark, folder, "part").withColumn("bad", F.when(F.col("p_partkey") % 7 == 0, F.lit("#NUM!")))
    cells = suppliers.unionByName(long("Parts", parts, "p_partkey", ["p_size", "p_retailprice"]))
    e = F.when(F.col("col") == 2, F.col("bad"))
    return cells.select("sheet", "row", "col", F.when(e.isNull(), F.col("v")).alias("v"), e.alias("e"))


_SQL_CELLS = "cells as (select 'suppliers' as sheet, s_suppkey+1 as row, unnest([1,2,3]) as col, unnest([s_suppkey::double, s_nationkey::double, s_acctbal]) as v, cast(null as varchar) as e from supplier union all select 'parts', p_partkey+1, 1, p_size::double, null from part union all select 'parts', p_partkey+1, 2, case when p_partkey%7<>0 then p_retailprice end, case when p_partkey%7=0 then '#NUM!' end from part)"


@_query(f"with {_SQL_CELLS}, x as (select o_orderkey, case o_orderkey%4 when 0 then 'Suppliers!$C$' when 1 then 'b' when 2 then 'PARTS!B' else 'Gone!A' end || (o_custkey%300) as t, case o_orderkey%4 when 0 then 'suppliers' when 1 then 'parts' when 2 then 'parts' end as s, case o_orderkey%4 when 0 then 3 else 2 end as c, o_custkey%300 as r from orders) select o_orderkey, t, v, case when s is null or r<1 then '#REF!' else e end as e from x left join cells on sheet=s and col=c and row=r and r>=1")
def ref_indirect_a1(spark, folder):
    """INDIRECT on A1 texts with and without a sheet: a cell that holds nothing is blank, no such sheet or row 0 is #REF!."""
    k = F.col("o_orderkey") % 4
    head = F.when(k == 0, "Suppliers!$C$").when(k == 1, "b").when(k == 2, "PARTS!B").otherwise("Gone!A")
    rows = sheet(spark, folder, "orders").select("o_orderkey", F.concat(head, (F.col("o_custkey") % 300).cast("string")).alias("t"))
    cells = _cells(spark, folder)
    return references.indirect(rows, "t", F.lit("Parts"), cells.select("sheet").distinct(), cells)


@_query("with a as (select s_suppkey as rect, s_suppkey+1 + (s_nationkey%3-2) as t, 1 + s_suppkey%2 as l, 1+s_suppkey%4 as h, 1+s_nationkey%2 as w from supplier), cells as (select s_suppkey+1 as row, unnest([1,2,3]) as col, unnest([s_suppkey::double, s_nationkey::double, s_acctbal]) as v from supplier) select rect, round(sum(v),2) as v, case when t<1 then '#REF!' end as e from a left join cells on t>=1 and row between t and t+h-1 and col between l and l+w-1 group by rect, t")
def ref_offset_area(spark, folder):
    """=SUM(OFFSET(A1, rows, columns, height, width)) with all four from the data, in a table that may be longer than a sheet.
    Areas of one key that begin in one row are one."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    move = n % 3 - 2
    t, l, b, r, e = references.offset_area(k + 1, F.lit(1), move, k % 2, 1 + k % 4, 1 + n % 2, limits=None)
    areas = sheet(spark, folder, "supplier").select(F.struct(k.alias("key"), move.alias("move")).alias("rect"), t.alias("top"), l.alias("left"), b.alias("bottom"), r.alias("right"), e.alias("e"))
    sums = references.area_sums(areas.where("e is null"), _cells(spark, folder).where("sheet = 'Suppliers'"), 64)
    return areas.select("rect", "e").distinct().join(sums, "rect", "left").select(F.col("rect.key").alias("rect"), (F.round(F.col("v") * 100) / 100).alias("v"), "e")


@_query("with x as (select s_suppkey as k, s_suppkey%5 as p, s_suppkey+1 as r1, 3 as c1, 1+s_nationkey as r2, 1 + s_suppkey%3 as c2 from supplier) select k, case when p<>4 then least(r1,r2) end as top, case when p<>4 then least(c1,c2) end as left, case when p<>4 then greatest(r1,r2) end as bottom, case when p<>4 then greatest(c1,c2) end as right, case when p<>4 then case p when 0 then null else 'Data' end end as sheet, case when p=4 then '#REF!' end as e from x")
def ref_range_hull(spark, folder):
    """The range operator between two cells: an end without a sheet takes the other's; two sheets have no range."""
    k = F.col("s_suppkey")
    name = lambda c, s="Data": F.when(c, F.lit(s))
    place = k % 5
    cell = lambda s, r, c: F.struct(s.alias("sheet"), r.cast("long").alias("row"), c.cast("long").alias("col"))
    a = cell(name(place.isin(1, 3, 4)), k + 1, F.lit(3))
    b = cell(F.coalesce(name(place.isin(2, 3)), name(place == 4, "Other")), 1 + F.col("s_nationkey"), 1 + k % 3)
    area, e = references.hull(a, b)
    return sheet(spark, folder, "supplier").select(k.alias("k"), area.alias("h"), e.alias("e")).select("k", "h.top", "h.left", "h.bottom", "h.right", "h.sheet", "e")


@_query("with c as (select s_suppkey+1 as row, s_acctbal as v from supplier) select k, place, v from (select s_suppkey as k, unnest([0,1,2]) as place, unnest([1, s_suppkey+1, s_suppkey+3]) as r from supplier) left join c on row=r")
def ref_literal_array(spark, folder):
    """{C1, RC, R[2]C}: a list of references, its cells in the order of the list."""
    k = F.col("s_suppkey")
    at = lambda r: F.struct(r.cast("long").alias("row"), F.lit(3).cast("long").alias("col"))
    rows = sheet(spark, folder, "supplier").select(k.alias("k"))
    rows = rows.withColumn("list", F.array(at(F.lit(1)), at(F.col("k") + 1), at(F.col("k") + 3)))
    return references.gathered(rows, F.col("list"), _cells(spark, folder).where("sheet = 'Suppliers'")).select("k", "place", "v")


@_query("select p_partkey%2 + 1 as col, count(*) as n, round(sum(p_retailprice),2) as v from part group by 1")
def ref_sparse(spark, folder):
    """A zig-zag down two columns over a whole sheet: only the cells that hold something are visited."""
    k = F.col("p_partkey")
    cells = sheet(spark, folder, "part").select((k * 1000 + 1).alias("row"), (k % 2 + 1).alias("col"), F.col("p_retailprice").alias("v"))
    area = cells.where(F.col("row").between(1, 1 << 60) & F.col("col").between(1, 2))
    return area.groupBy("col").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 2).alias("v"))


def _part_table(spark, folder) -> Table:
    headings = {"Key": "p_partkey", "Size [mm]": "p_size", "#Price": "p_retailprice"}
    totals = {"Size [mm]": F.sum("p_size"), "#Price": F.round(F.sum("p_retailprice"), 2).cast("decimal(30,2)")}
    return Table(sheet(spark, folder, "part"), "p_partkey", headings, totals)


@_query("select 'Headers' as section, cast(null as bigint) as k, h as heading, h as v from (select unnest(['Size [mm]','#Price']) as h) union all select 'Data', p_partkey, 'Size [mm]', p_size::varchar from part union all select 'Data', p_partkey, '#Price', p_retailprice::varchar from part union all select 'Totals', null, 'Size [mm]', sum(p_size)::varchar from part union all select 'Totals', null, '#Price', round(sum(p_retailprice),2)::decimal(30,2)::varchar from part")
def ref_structured_all(spark, folder):
    """T[[#All],[Size '[mm']]:['#Price]]: headings, data and totals of neighbouring columns, with escaped headings."""
    return _part_table(spark, folder).section("#All", first="size '[mm']", last="'#PRICE")


@_query("select p_partkey, p_size*p_retailprice as v from part")
def ref_structured_row(spark, folder):
    """=[@[Size '[mm']]]*[@['#Price]]: cells of the formula's own row."""
    table = _part_table(spark, folder)
    return table.rows.select("p_partkey", (table.this_row("Size '[mm']") * table.this_row("'#Price")).alias("v"))


@_query("select p_partkey, case p_partkey%3 when 0 then c_acctbal when 2 then s_acctbal end as v, case when p_partkey%3=1 then '#REF!' end as e from part left join customer on c_custkey=p_partkey and p_partkey%3=0 left join supplier on s_suppkey=p_partkey and p_partkey%3=2")
def ref_deleted_sheet(spark, folder):
    """References by a third of the parts each to a sheet that is renamed, to one that is deleted and made anew, and to one that
    comes into being later: the second stays #REF!."""
    customers = sheet(spark, folder, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    suppliers = sheet(spark, folder, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"))
    book = Workbook({"Here": customers, "Gone": suppliers})
    kept, lost, later = book.refer("HERE"), book.refer("Gone"), book.refer("Later")
    book.rename("Here", "Renamed")
    book.delete("Gone")
    book.add("Gone", suppliers)
    book.add("later", suppliers)
    parts = sheet(spark, folder, "part").select("p_partkey")
    found = [book.read(r, parts.where(F.col("p_partkey") % 3 == i), "p_partkey", "k", "v") for i, r in enumerate((kept, lost, later))]
    return found[0].unionByName(found[1]).unionByName(found[2]).select("p_partkey", "v", "e")


@_query("select c_custkey, case when c_custkey%2=0 then s_acctbal end as v, case when c_custkey%2=1 then '#REF!' end as e from customer left join supplier on s_suppkey=c_custkey%100 and c_custkey%2=0")
def source_external(spark, folder):
    """References into another workbook: cells are gathered from one that is loaded, one that is not is #REF!."""
    suppliers = sheet(spark, folder, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"))
    books = {"Loaded": Workbook({"Sheet1": suppliers})}
    rows = sheet(spark, folder, "customer").select("c_custkey", (F.col("c_custkey") % 100).alias("at"))
    inside = books["Loaded"].read(books["Loaded"].refer("sheet1"), rows.where("c_custkey % 2 = 0"), "at", "k", "v")
    missing = books.get("Missing", Workbook({}))
    outside = missing.read(missing.refer("Sheet1"), rows.where("c_custkey % 2 = 1"), "at", "k", "v")
    return inside.unionByName(outside).select("c_custkey", "v", "e")


# aggregates ------------------------------------------------------------------------------------------------------------


def _option_sql(option: int) -> str:
    keep = [c for c, on in (("o_orderkey%10<>0", option < 4), ("o_custkey%2=0", option % 2), ("o_custkey%50<>3", option % 4 >= 2)) if on]
    where = " and ".join(keep) or "true"
    err = "sum(case when o_custkey%50=3 then 1 else 0 end)"
    return f"select {option} as option, case when {err}=0 then round(sum(o_totalprice),2) end as v, case when {err}>0 then '#DIV/0!' end as e from orders where {where}"


@_query(" union all ".join(map(_option_sql, range(8))))
def agg_aggregate_options(spark, folder):
    """AGGREGATE(9, option, area) for all eight options: nested subtotals, hidden rows and errors in the area."""
    rows = sheet(spark, folder, "orders")
    err = F.when(F.col("o_custkey") % 50 == 3, F.lit("#DIV/0!"))
    hidden, nested = F.col("o_custkey") % 2 == 1, F.col("o_orderkey") % 10 == 0
    out = None
    for option in range(8):
        one = aggregates.aggregate_option(rows, 9, option, F.col("o_totalprice"), err, hidden, nested)
        one = one.select(F.lit(option).alias("option"), F.round("v", 2).alias("v"), "e")
        out = one if out is None else out.unionByName(one)
    return out


_BLOCKS = "select (r-1)//64 as g, (r-1)%64 as i, p from (select row_number() over (order by o_orderkey) as r, o_totalprice/3 as p from orders)"


@_query(f"select g, list_reduce(list(p order by i), lambda a, b: a + b, 0.0::double) as v from ({_BLOCKS}) group by g")
def agg_left_fold(spark, folder):
    """Sums of blocks of 64 orders, exactly as a fold from the left gives them."""
    rows = ordered.addressed(sheet(spark, folder, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")
    return aggregates.reduced(rows, F.floor((F.col("row") - 1) / 64), F.col("row"), F.col("o_totalprice") / 3, "left_fold")


def _pairwise_sql() -> str:
    level = f"l0 as ({_BLOCKS})"
    for n in range(6):
        level += f", l{n + 1} as (select g, i//2 as i, max(case when i%2=0 then p end) + coalesce(max(case when i%2=1 then p end), 0) as p from l{n} group by g, i//2)"
    return f"with {level} select g, p as v from l6"


@_query(_pairwise_sql())
def agg_pairwise(spark, folder):
    """The same blocks summed as trees of pairs."""
    rows = ordered.addressed(sheet(spark, folder, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")
    return aggregates.reduced(rows, F.floor((F.col("row") - 1) / 64), F.col("row"), F.col("o_totalprice") / 3, "pairwise")


@_query(f"with b as (select g, list(p order by i) as x from ({_BLOCKS}) group by g), k as (select g, list_reduce(list_transform(x, lambda y: [y, 0.0::double]), lambda a, y: [a[1] + (y[1] - a[2]), ((a[1] + (y[1] - a[2])) - a[1]) - (y[1] - a[2])], [0.0::double, 0.0::double]) as s from b) select g, s[1] as v from k")
def agg_kahan(spark, folder):
    """The same blocks with Kahan's compensation, to the last bit."""
    rows = ordered.addressed(sheet(spark, folder, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")
    return aggregates.reduced(rows, F.floor((F.col("row") - 1) / 64), F.col("row"), F.col("o_totalprice") / 3, "kahan")


# functions of the recalculation ----------------------------------------------------------------------------------------


@_query("select 'customer' as sheet, c_custkey as k, 46000.75::double as now, 46000.0::double as today, 46000.75 - c_acctbal as age from customer union all select 'supplier', s_suppkey, 46000.75, 46000.0, 46000.75 - s_acctbal from supplier")
def fn_now_today(spark, folder):
    """All cells of all sheets of one recalculation see one time."""
    tick = Tick(46000.75, 42)
    one = lambda t, k, v: sheet(spark, folder, t).select(F.lit(t).alias("sheet"), F.col(k).alias("k"), tick.now().alias("now"), tick.today().alias("today"), (tick.now() - F.col(v)).alias("age"))
    return one("customer", "c_custkey", "c_acctbal").unionByName(one("supplier", "s_suppkey", "s_acctbal"))


# spills ----------------------------------------------------------------------------------------------------------------


@_query("with f as (select p_partkey as anchor, p_size%5+1 as n, p_size%3=0 as blocked from part), g as (select a.anchor, case when a.anchor%2=0 then a.n else 1 + coalesce(case when b.blocked then 1 else b.n end, 0) end as rows, a.blocked from f a left join f b on b.anchor=a.anchor-1) select * from g")
def spill_repair(spark, folder):
    """The array of an odd part is one longer than what its neighbour before it shows: facts are evaluated again until they hold."""
    own = sheet(spark, folder, "part").select(F.col("p_partkey").alias("anchor"), (F.col("p_size") % 5 + 1).cast("long").alias("n"), (F.col("p_size") % 3 == 0).alias("blocked"))

    def step(facts):
        shown = facts.select((F.col("anchor") + 1).alias("anchor"), F.when(F.col("blocked"), 1).otherwise(F.col("rows")).alias("shown"))
        rows = F.when(F.col("anchor") % 2 == 0, F.col("n")).otherwise(1 + F.coalesce("shown", F.lit(0)))
        return own.join(shown, "anchor", "left").select("anchor", rows.cast("long").alias("rows"), "blocked")

    return spills.repaired(own.select("anchor", F.lit(0).cast("long").alias("rows"), F.lit(False).alias("blocked")), step)


@_query("select p_partkey as anchor, p_partkey*10 + i as row from part, lateral (select unnest(range(0, p_size%8+1)) as i) where i > p_size%3")
def spill_vacated(spark, folder):
    """Arrays that get shorter: the rows that they leave are cleared."""
    k = F.col("p_partkey")
    extent = lambda n: sheet(spark, folder, "part").select(k.alias("anchor"), (k * 10).alias("top"), (k * 10 + n).alias("bottom"))
    return spills.vacated(extent(F.col("p_size") % 8), extent(F.col("p_size") % 3))


@_query("select l_orderkey as consumer from lineitem join part on p_partkey=l_partkey where p_partkey%4=0 group by 1")
def spill_consumers(spark, folder):
    """Orders read the spills of their parts; those of parts whose spill changed run again."""
    now = sheet(spark, folder, "part").select(F.col("p_partkey").alias("anchor"), (F.col("p_size") % 8).alias("rows"), F.lit(False).alias("blocked"), (F.col("p_partkey") % 10).alias("digest"))
    before = now.withColumn("digest", F.when(F.col("anchor") % 4 == 0, -1).otherwise(F.col("digest"))).withColumn("epoch", F.lit(1))
    consumers = sheet(spark, folder, "lineitem").select(F.col("l_orderkey").alias("consumer"), F.col("l_partkey").alias("anchor"))
    return spills.consumers_to_run(before, spills.epochs(before, now), consumers)


# edits and differences -------------------------------------------------------------------------------------------------

_PART_CELLS = "(select p_partkey as row, unnest([1,2]) as col, unnest([p_size::double, p_retailprice]) as v from part)"


@_query(f"select row, case when col>=2 then col+3 else col end as col, v from {_PART_CELLS}")
def edit_insert_columns(spark, folder):
    return references.moved_cells(_part_cells(spark, folder), "col", 2, 3)


@_query(f"select row, col-1 as col, v from {_PART_CELLS} where col<>1")
def edit_delete_columns(spark, folder):
    return references.moved_cells(_part_cells(spark, folder), "col", 1, -1)


def _part_cells(spark, folder):
    cells = F.array(*(F.struct(F.lit(i).alias("col"), F.col(c).cast("double").alias("v")) for i, c in enumerate(("p_size", "p_retailprice"), 1)))
    return sheet(spark, folder, "part").select(F.col("p_partkey").alias("row"), F.inline(cells))


@_query("select s_suppkey, case when c between 5 and 9 then null when c>=10 then c-5 else c end as c, case when c between 5 and 9 then '#REF!' end as e from (select s_suppkey, s_nationkey as c from supplier)")
def edit_point_delete(spark, folder):
    """References to columns of which five go."""
    at, e = references.moved_point(F.col("s_nationkey"), 5, -5)
    return sheet(spark, folder, "supplier").select("s_suppkey", at.alias("c"), e.alias("e"))


def _name_edits(spark, folder):
    k = F.col("s_suppkey")
    names = sheet(spark, folder, "supplier").select(F.concat(F.lit("N"), k.cast("string")).alias("name"), k.alias("k"))
    deleted = names.where("k % 10 = 1").select("name")
    renamed = names.where("k % 10 = 2").select("name", F.concat(F.lit("R_"), "name").alias("to"))
    resized = names.where("k % 10 = 3").select("name", (F.col("k") + 50).alias("bottom"), F.lit(9).cast("long").alias("right"))
    return names, renamed, deleted, resized


@_query("select case when s_suppkey%10=2 then 'R_' else '' end || 'N' || s_suppkey as name, s_suppkey as top, 1 as left, s_suppkey + case when s_suppkey%10=3 then 50 else 5 end as bottom, case when s_suppkey%10=3 then 9 else 4 end as right from supplier where s_suppkey%10<>1")
def edit_names(spark, folder):
    """A catalog of tables and names of which some are deleted, renamed or resized."""
    names, renamed, deleted, resized = _name_edits(spark, folder)
    k = F.col("k")
    catalog = names.select("name", k.alias("top"), F.lit(1).cast("long").alias("left"), (k + 5).alias("bottom"), F.lit(4).cast("long").alias("right"))
    return edited(catalog, renamed, deleted, resized)


@_query("select p_partkey, case when s_suppkey%10=1 then null when s_suppkey%10=2 then 'R_N'||s else 'N'||s end as name, case when s_suppkey%10=1 then '#NAME?' end as e from (select p_partkey, p_partkey%100 as s from part) left join supplier on s_suppkey=s")
def edit_name_uses(spark, folder):
    """Formulas that use those names: renamed ones follow, deleted ones are #NAME?; names outside the catalog stay as they are."""
    _, renamed, deleted, _ = _name_edits(spark, folder)
    uses = sheet(spark, folder, "part").select("p_partkey", F.concat(F.lit("N"), (F.col("p_partkey") % 100).cast("string")).alias("name"))
    return rewritten(uses, renamed, deleted).select("p_partkey", "name", "e")


@_query("select p_partkey, 'changed' as change, p_retailprice as old_v, p_retailprice*2 as new_v, 1 as old_rows, (case when p_partkey%20=0 then 2 else 1 end) as new_rows from part where p_partkey%10=0")
def delta_publication(spark, folder):
    """What a recalculation publishes since the one before: values and spill facts that differ, nothing else."""
    rows = sheet(spark, folder, "part")
    old = rows.select("p_partkey", F.col("p_retailprice").alias("v"), F.lit(1).alias("rows"))
    some = F.col("p_partkey") % 10 == 0
    new = rows.select("p_partkey", F.when(some, F.col("p_retailprice") * 2).otherwise(F.col("p_retailprice")).alias("v"), F.when(F.col("p_partkey") % 20 == 0, 2).otherwise(1).alias("rows"))
    return edits.delta(old, new, "p_partkey", ["v", "rows"]).select("p_partkey", "change", "old_v", "new_v", "old_rows", "new_rows")


_SPAN = "select a.s_suppkey as span, b.s_suppkey as member from supplier a join supplier b on {} between a.s_suppkey and a.s_suppkey+9 where a.s_suppkey%20=0"


@_query(f"with o as ({_SPAN.format('b.s_suppkey')}), n as ({_SPAN.format('(case when b.s_suppkey%50=3 then b.s_suppkey+20 else b.s_suppkey end)')}) select 'added' as change, span, member from (select * from n except select * from o) union all select 'removed', span, member from (select * from o except select * from n)")
def delta_span_members(spark, folder):
    """Spans of ten sheets each; some sheets move twenty places, and the spans' members change."""
    k = F.col("s_suppkey")
    rows = sheet(spark, folder, "supplier")
    none = F.lit(0).cast("long")
    spans = rows.where(k % 20 == 0).select(k.alias("rect"), k.alias("top"), (k + 9).alias("bottom"), none.alias("left"), none.alias("right"))

    def members(place):
        points = rows.select(k.alias("point"), place.cast("long").alias("row"), none.alias("col"))
        return lookups.rects_hit(points, spans, 64).select(F.col("rect").alias("span"), F.col("point").alias("member"))

    old, new = members(k), members(F.when(k % 50 == 3, k + 20).otherwise(k))
    added = new.exceptAll(old).select(F.lit("added").alias("change"), "span", "member")
    return added.unionByName(old.exceptAll(new).select(F.lit("removed").alias("change"), "span", "member"))


@_query("select p_partkey, p_size%4<3 as admitted from part")
def capability_superset(spark, folder):
    """What a value asks of its host, against what the host has: all of it must be there."""
    wanted = F.slice(F.array(*map(F.lit, ("array", "image", "format", "entity"))), F.lit(1), (F.col("p_size") % 4 + 1).cast("int"))
    has = F.array(*map(F.lit, ("format", "array", "image")))
    return sheet(spark, folder, "part").select("p_partkey", (F.size(F.array_except(wanted, has)) == 0).alias("admitted"))


# viewports, visibility, graphs -----------------------------------------------------------------------------------------


@_query(f"select * from (select {_ROW} as r, o_totalprice*2+1 as shown from orders) where r between 5001 and 5040")
def view_upstream_cone(spark, folder):
    """Of a region of formulas only what the visible column needs, for the visible rows only."""
    formulas = {
        "double": (["o_totalprice"], F.col("o_totalprice") * 2),
        "other": (["o_custkey"], F.col("o_custkey") * 3),
        "shown": (["double"], F.col("double") + 1),
        "right": (["shown", "other"], F.col("shown") + F.col("other")),
    }
    rows = cone(sheet(spark, folder, "orders"), ["o_orderkey"], formulas, ["shown"])
    return ordered.rows_at(rows, "o_orderkey", first=5001, last=5040).select(F.col("row").alias("r"), "shown")


@_query("select distinct s_suppkey as formula from supplier join orders on o_orderkey between s_suppkey*100 and s_suppkey*100+40 where s_suppkey%2=0 and o_custkey%97=5")
def view_axis_closure(spark, folder):
    """Rows get hidden: formulas that leave out hidden rows and reach over one of them are dirty."""
    k, none = F.col("s_suppkey"), F.lit(0).cast("long")
    hidden = sheet(spark, folder, "orders").where("o_custkey % 97 = 5")
    hidden = hidden.select(F.col("o_orderkey").alias("point"), F.col("o_orderkey").alias("row"), none.alias("col"))
    areas = sheet(spark, folder, "supplier").where(k % 2 == 0)
    areas = areas.select(k.alias("rect"), (k * 100).alias("top"), (k * 100 + 40).alias("bottom"), none.alias("left"), none.alias("right"))
    return lookups.rects_hit(hidden, areas).select(F.col("rect").alias("formula")).distinct()


_CHAIN = "select c_custkey-1 as source, c_custkey as target from customer where c_custkey%1000<>0"


@_query("select c_custkey as node, (c_custkey%1000 - 7)::bigint as depth from customer where c_custkey%1000>=7")
def dependency_chain(spark, folder):
    """Chains of a thousand formulas, dirty from the eighth on: pointers are doubled along them."""
    key = F.col("c_custkey")
    rows = sheet(spark, folder, "customer")
    edges = rows.where(key % 1000 != 0).select((key - 1).alias("source"), key.alias("target"))
    return graph.closure(edges, rows.where(key % 1000 == 7).select(key.alias("node")))


@_query("with s as (select s_suppkey k, s_suppkey%10 d, (s_suppkey//10)%2 as odd from supplier) select k as node, case when odd=1 and d>=4 then 'CycleBlocked' when d=2 then 'Seed' else 'UpstreamPublication' end as state, case when d=2 then 'External,Volatile' else '' end as reasons from s where d>=2")
def dependency_reasons(spark, folder):
    """In tens of suppliers each depends on the one before; in every second ten the sixth also on the eighth, a cycle."""
    k = F.col("s_suppkey")
    rows = sheet(spark, folder, "supplier")
    chain = rows.where(k % 10 != 0).select((k - 1).alias("source"), k.alias("target"))
    back = rows.where((k % 10 == 6) & (F.floor(k / 10) % 2 == 1)).select(k.alias("source"), (k - 2).alias("target"))
    seeds = rows.where(k % 10 == 2).select(k.alias("node"), F.explode(F.array(F.lit("Volatile"), F.lit("External"), F.lit("Volatile"))).alias("reason"))
    return graph.invalidated(chain.unionByName(back), seeds)


# trees -----------------------------------------------------------------------------------------------------------------


@_query("select c_custkey as k, case when c_nationkey=n_nationkey then 'c'||c_custkey end as node from customer left join nation on n_nationkey=c_nationkey and c_custkey%3<>0")
def tree_paths(spark, folder):
    """Paths of names from the root: region, nation, customer; every third goes through a nation that is not there."""
    nodes = _tree(spark, folder).withColumn("name", F.concat(F.lit("the "), "node"))
    nation = sheet(spark, folder, "nation").select("n_nationkey", "n_regionkey")
    rows = sheet(spark, folder, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    step = lambda p, c: F.concat(F.lit(f"the {p}"), c.cast("string"))
    wrong = F.when(F.col("c_custkey") % 3 == 0, F.lit("nobody")).otherwise(step("n", F.col("c_nationkey")))
    paths = rows.select(F.col("c_custkey").alias("k"), F.array(step("r", F.col("n_regionkey")), wrong, step("c", F.col("c_custkey"))).alias("path"))
    return trees.at_paths(nodes, paths).select("k", "node")


@_query("select 'c'||c_custkey as node, 'c'||lead(c_custkey, 2) over (partition by c_nationkey order by c_custkey) as sibling from customer")
def tree_sibling_offset(spark, folder):
    nodes = _tree(spark, folder)
    return trees.sibling_at(nodes.where("node like 'c%'"), 2)


# streams ---------------------------------------------------------------------------------------------------------------


@_query("select c_custkey as node, case when c_custkey%5=0 then 'Created' when c_custkey%5=1 then 'Released' else 'Replaced' end as action, case when c_custkey%5<>0 then 't'||c_nationkey end as was, case when c_custkey%5<>1 then 't'||(c_nationkey + case when c_custkey%5=2 then 1 else 0 end) end as topic, case when c_custkey%5=0 then 'PreparedRuntimeEffect' when c_custkey%5=1 then 'FormulaRemoved' else 'FormulaTextChanged' end as reason from customer where c_custkey%5<3")
def stream_lifecycle(spark, folder):
    """Subscriptions before and after an edit: created, released and replaced ones, with the reason."""
    k = F.col("c_custkey")
    topic = lambda more: F.concat(F.lit("t"), (F.col("c_nationkey") + more).cast("string"))
    rows = sheet(spark, folder, "customer")
    old = rows.where(k % 5 != 0).select(k.alias("node"), topic(0).alias("topic_id"))
    new = rows.where(k % 5 != 1).select(k.alias("node"), topic(F.when(k % 5 == 2, 1).otherwise(0)).alias("topic_id"))
    return topics.lifecycle(old, new)


@_query("select p_partkey, case when p_size%6=5 then p_retailprice end as v, case p_size%6 when 0 then 'CapabilityDenied' when 1 then 'CapabilityDenied' when 2 then 'NoValueYet' when 3 then 'ConnectionFailed' when 4 then 'ProviderError' else 'Value' end as state, case when p_size%6=4 then '#NUM!' end as e, p_size%6=2 as pending from part")
def stream_modes(spark, folder):
    """What a topic's provider answers: a value, an error of its own, nothing yet, or a refusal."""
    mode = F.get(F.array(*map(F.lit, topics.MODES)), (F.col("p_size") % 6).cast("int"))
    rows = sheet(spark, folder, "part").select("p_partkey", mode.alias("mode"), F.col("p_retailprice").alias("number"), F.lit("#NUM!").alias("error"))
    return topics.answers(rows).select("p_partkey", "v", "state", "e", "pending")


# formats ---------------------------------------------------------------------------------------------------------------


@_query("with t as (select quantile_cont(c_acctbal,0.1) as lo, min(c_acctbal) + 0.9*(max(c_acctbal)-min(c_acctbal)) as hi from customer) select c_custkey, round(least(1, greatest(0, (c_acctbal-lo)/(hi-lo))),9) as v from customer, t")
def format_data_bar(spark, folder):
    """The length of a bar between a percentile and a share of the range."""
    rows = sheet(spark, folder, "customer")
    low, high = ordered.thresholds(rows, "c_acctbal", [("percentile", 10), ("percent", 90)])
    place = (F.col("c_acctbal") - low) / (high - low)
    return rows.select("c_custkey", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), place)), 9).alias("v"))


@_query("with t as (select min(c_acctbal) as a, (min(c_acctbal)+max(c_acctbal))/2 as b, 5000.0::double as c, max(c_acctbal) as d from customer) select c_custkey, (case when c_acctbal>=d then 4 when c_acctbal>=c then 3 when c_acctbal>=b then 2 else 1 end)::int as v from customer, t")
def format_thresholds(spark, folder):
    """Icons by thresholds of four kinds: least, middle, a number, greatest."""
    rows = sheet(spark, folder, "customer")
    cuts = ordered.thresholds(rows, "c_acctbal", [("min", None), ("mid", None), ("number", 5000), ("max", None)])
    place = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("c_acctbal")))
    return rows.select("c_custkey", place.alias("v"))
