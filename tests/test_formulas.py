"""Formula semantics on small sheets: golden values, blanks and errors."""

import math

import pytest
from pyspark.sql import functions as F

from loomsheet.functions import cells as C
from loomsheet.functions import scalar as S
from loomsheet.functions import text as T
from loomsheet.operators import aggregates, edits, lookups, spills, trees
from loomsheet.plans import graph, ordered


def one(spark, made):
    return tuple(spark.range(1).select(*made).first())


@pytest.mark.parametrize(
    ("formula", "v", "e"),
    [
        (lambda: C.cell(7) * 3, 21.0, None),
        (lambda: C.sum_(7, C.cell(7) * 3), 28.0, None),
        (lambda: C.cell(1) / 0, None, "#DIV/0!"),
        (lambda: C.cell(1) / 0 + S.sqrt(-1), None, "#DIV/0!"),
        (lambda: S.sqrt(-1) + C.cell(1) / 0, None, "#NUM!"),
        (lambda: C.iferror(C.cell(1) / 0, 5), 5.0, None),
        (lambda: C.if_(C.cell(1) > 0, 2, C.cell(1) / 0), 2.0, None),
        (lambda: C.if_(C.cell(1) / 0 > 0, 2, 3), None, "#DIV/0!"),
        (lambda: S.mod(-7, 3), 2.0, None),
        (lambda: S.mod(7, -3), -2.0, None),
        (lambda: S.mod(7, 0), None, "#DIV/0!"),
        (lambda: S.round_(1.005, 2), 1.0, None),
        (lambda: S.round_(0.285, 2), 0.28, None),
        (lambda: S.round_(-2.5), -3.0, None),
        (lambda: S.round_(1250, -2), 1300.0, None),
        (lambda: S.roundup(-1.21, 1), -1.3, None),
        (lambda: S.rounddown(-1.29, 1), -1.2, None),
        (lambda: S.round_(1, 400), None, "#NUM!"),
        (lambda: S.int_(-1.5), -2.0, None),
        (lambda: S.trunc(-1.5), -1.0, None),
        (lambda: S.power(0, -1), None, "#NUM!"),
        (lambda: S.power(-8, 1 / 3), None, "#NUM!"),
        (lambda: S.exp(1000), None, "#NUM!"),
        (lambda: S.ln(0), None, "#NUM!"),
        (lambda: S.log(8, 2), 3.0, None),
        (lambda: S.log(8, 1), None, "#DIV/0!"),
        (lambda: S.log(8, -1), None, "#NUM!"),
        (lambda: S.pi(), math.pi, None),
        (lambda: C.product(F.lit(None).cast("double")), 0.0, None),
        (lambda: C.average(F.lit(None).cast("double")), None, "#DIV/0!"),
        (lambda: C.min_(F.lit(None).cast("double")), 0.0, None),
        (lambda: C.count(1, F.lit(None).cast("double"), 3), 2.0, None),
        (lambda: C.cell(F.lit(None).cast("double")) + 1, 1.0, None),
    ],
)
def test_values(spark, formula, v, e):
    got = one(spark, formula().columns())
    assert got[1] == e
    assert got[0] == v or math.isclose(got[0], v, rel_tol=1e-12)


def test_errors_beat_deciding_arguments(spark):
    bad = C.cell(1) / 0 > 1
    assert one(spark, C.or_(C.cell(1) > 0, bad).columns()) == (None, "#DIV/0!")
    assert one(spark, C.and_(C.cell(1) < 0, bad).columns()) == (None, "#DIV/0!")


def test_text_counts_code_units(spark):
    text = F.lit("a😀b")
    assert one(spark, T.len_(text).columns()) == (4.0, None)
    assert one(spark, T.left(text, 3)) == ("a😀", None)
    assert one(spark, T.right(F.lit("plain"), 2)) == ("in", None)
    assert one(spark, T.left(text, -1)) == (None, "#VALUE!")
    assert one(spark, T.len_(F.lit(None).cast("string")).columns())[1] == "#VALUE!"


def test_error_codes(spark):
    rows = spark.createDataFrame([(e,) for e in C.ERRORS], "e string")
    back = rows.select("e", C.error_of_code(C.error_code(F.col("e"))).alias("b")).collect()
    assert all(r.e == r.b for r in back)
    assert one(spark, [C.error_of_code(F.lit(99))]) == ("#VALUE!",)


def test_first_error_and_subtotal(spark):
    rows = spark.createDataFrame([(1, 10.0, None), (2, None, "#N/A"), (3, None, "#NULL!")], "row int, v double, e string")
    found = aggregates.column_aggregates(rows, F.col("v"), F.col("e"), F.col("row")).first()
    assert found["e"] == "#N/A" and found["s"] is None
    assert aggregates.dominant_error(rows, F.col("e")).first()["e"] == "#NULL!"
    sheet = spark.createDataFrame([(10.0, False, False), (20.0, False, True), (30.0, True, False)], "v double, f boolean, h boolean")
    total = lambda code: aggregates.subtotal(sheet, code, F.col("v"), F.col("f"), F.col("h")).first()["v"]
    assert (total(109), total(9)) == (10.0, 30.0)


def test_compensated_sum_does_not_depend_on_partitions(spark):
    rows = spark.range(1, 20_001).select(F.col("id").alias("row"), (1 / F.col("id")).alias("v"))
    sums = {aggregates.compensated_sum(rows.repartition(n), "row", F.col("v")).first()["v"] for n in (1, 3, 7)}
    assert len(sums) == 1
    assert math.isclose(sums.pop(), math.fsum(1 / i for i in range(1, 20_001)), rel_tol=1e-15)


def test_ordered(spark):
    rows = spark.createDataFrame([(k * 3 % 101, float(k)) for k in range(101)], "k int, v double")
    got = {r.k: r.row for r in ordered.addressed(rows, "k").collect()}
    assert got == {k: k + 1 for k in range(101)}
    assert ordered.addressed(rows.limit(0), "k").count() == 0
    lag = {"b": F.lag("v", 2).over(ordered.frame())}
    found = ordered.offset_frames(ordered.addressed(rows, "k"), 2, lag, rows=7).orderBy("row").collect()
    assert [r.b for r in found] == [None, None, *(r.v for r in found[:-2])]


def test_lookups(spark):
    table = spark.createDataFrame([(1, 5, "a"), (2, 5, "b"), (3, 6, "c")], "row int, k int, v string")
    rows = spark.createDataFrame([(5,), (7,)], "x int")
    assert {tuple(r) for r in lookups.vlookup(rows, F.col("x"), table, "k", "v", "row").collect()} == {(5, "a", None), (7, None, "#N/A")}
    at = spark.createDataFrame([(0,), (3,), (4,)], "x int")
    side = table.select("row", "v")
    assert {tuple(r) for r in lookups.index(at, F.col("x"), side, "row", "v", F.lit(3)).collect()} == {
        (0, None, "#VALUE!"),
        (3, "c", None),
        (4, None, "#REF!"),
    }


def test_edits_and_delta(spark):
    rows = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 30.0)], "row int, v double")
    assert [tuple(r) for r in edits.insert_rows(rows, "row", 2, 2).orderBy("row").collect()] == [(1, 10.0), (4, 20.0), (5, 30.0)]
    assert [tuple(r) for r in edits.delete_rows(rows, "row", 2, 1).orderBy("row").collect()] == [(1, 10.0), (2, 30.0)]
    new = spark.createDataFrame([(1, 10.0), (2, 21.0), (4, None)], "row int, v double")
    assert {tuple(r) for r in edits.delta(rows, new, "row", ["v"]).collect()} == {
        (2, "changed", 20.0, 21.0),
        (3, "cleared", 30.0, None),
        (4, "set", None, None),
    }
    assert {tuple(r) for r in edits.overlaid(rows, "row", spark.createDataFrame([(3, None), (9, 1.0)], "row int, v double"), "v").collect()} == {
        (1, 10.0),
        (2, 20.0),
        (3, None),
        (9, 1.0),
    }


def test_spills_block_each_other(spark):
    extents = spark.createDataFrame([(1, 1, 1, 3, 1), (2, 2, 1, 4, 1), (3, 9, 1, 11, 1), (4, spills.MAX_ROWS, 1, spills.MAX_ROWS + 1, 1)], "anchor long, top long, left long, bottom long, right long")
    none = spark.createDataFrame([], "owner long, top long, left long, bottom long, right long")
    got = {r.anchor: r.blocked for r in spills.arbitrated(extents, none).collect()}
    assert got == {1: True, 2: True, 3: False, 4: True}


def test_trees_and_graphs(spark):
    nodes = spark.createDataFrame([("r", None, 0), ("a", "r", 0), ("b", "r", 1), ("c", "a", 0)], "node string, parent string, ord int")
    down = trees.descendants(nodes, spark.createDataFrame([("r",)], "node string")).orderBy("path").collect()
    assert [r.descendant for r in down] == ["a", "c", "b"]
    assert trees.descendants(nodes, spark.createDataFrame([("c",)], "node string")).count() == 0
    up = trees.ancestors(nodes, spark.createDataFrame([("c",), ("b",)], "node string")).collect()
    assert [(r.node, r.ancestor) for r in up] == [("c", "a")]
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 1)], "source int, target int")
    assert {(r.node, r.group) for r in graph.cycle_groups(edges).collect()} == {(1, 1), (2, 1), (3, 1)}
    reached = graph.closure(edges, spark.createDataFrame([(3,)], "node int"))
    assert {r.node: r.depth for r in reached.collect()} == {3: 0, 1: 1, 4: 1, 2: 2}
    cells = spark.createDataFrame([(1, 0.0, 0.0)], "node int, base double, value double")
    with pytest.raises(ValueError, match="no fixed point"):
        graph.jacobi(cells.withColumn("base", F.lit(1.0)), spark.createDataFrame([(1, 1, 1.0)], "source int, target int, weight double"), most=5)


def test_cycle_groups_leave_out_what_lies_between(spark):
    """Two rings with a bridge, a node that refers to itself, a chain: groups against reachability both ways."""
    pairs = [(1, 2), (2, 1), (2, 3), (3, 4), (4, 5), (5, 6), (6, 4), (7, 7), (7, 8), (8, 9), (10, 11), (11, 12), (12, 10), (11, 10)]
    edges = spark.createDataFrame(pairs, "source int, target int")
    reach = {p: True for p in pairs}
    nodes = range(1, 13)
    for k in nodes:
        for a in nodes:
            for b in nodes:
                if (a, k) in reach and (k, b) in reach:
                    reach[a, b] = True
    want = {(a, min(b for b in nodes if (a, b) in reach and (b, a) in reach)) for a in nodes if (a, a) in reach}
    assert {(r.node, r.group) for r in graph.cycle_groups(edges).collect()} == want
    assert graph.cycle_groups(edges.limit(0)).count() == 0


def test_long_rings_are_groups(spark):
    chain = [(i, i + 1) for i in range(900, 1200)]
    ring = [(1200 + i, 1200 + (i + 1) % 400) for i in range(400)]
    out = [(1300, 0), *((i, i + 1) for i in range(200))]
    alone = [(2000 + i * 7 % 300, 2000 + (i + 1) * 7 % 300) for i in range(300)]
    edges = spark.createDataFrame(chain + ring + out + alone, "source int, target int")
    want = {(1200 + i, 1200) for i in range(400)} | {(2000 + i, 2000) for i in range(300)}
    rows = [tuple(r) for r in graph.cycle_groups(edges, most=20).collect()]
    assert sorted(rows) == sorted(want)


def test_long_chains_close(spark):
    """A chain far longer than the rounds it takes, a ring, a shorter way into the chain, and seeds inside it."""
    chain = [(i, i + 1) for i in range(3000)] + [(5000, 5001), (5001, 5000), (0, 9000), (9000, 2990)]
    edges = spark.createDataFrame(chain, "source int, target int")
    got = {r.node: r.depth for r in graph.closure(edges, spark.createDataFrame([(0,), (1500,)], "node int")).collect()}
    assert got == {**{i: i if i < 1500 else min(i - 1500, i - 2988 if i >= 2990 else i) for i in range(3001)}, 9000: 1}
    ring = graph.closure(edges, spark.createDataFrame([(5000,)], "node int")).collect()
    assert {r.node: r.depth for r in ring} == {5000: 0, 5001: 1}


def test_structured_names_and_a1_texts(spark):
    from loomsheet.operators.references import a1_address
    from loomsheet.operators.tables import column_name

    assert [column_name(t) for t in ("a", "'#b", "it''s", "'[x']")] == ["a", "#b", "it's", "[x]"]
    texts = {"A1": (None, 1, 1), "$xfd$7": (None, 7, 16384), "'My sheet'!AA10": ("My sheet", 10, 27), "XFE1": None, "A0": None, "A1048577": None, "": None, "1A": None, "S!": None}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", a1_address(F.col("t")).alias("at")).collect()
    assert {r.t: r["at"] and tuple(r["at"]) for r in rows} == texts


def test_cones_leave_out_what_is_not_read(spark):
    from loomsheet.plans.cone import cone

    df = spark.range(2).toDF("x")
    formulas = {"a": (["x"], F.col("x") + 1), "b": (["a"], F.col("a") * 2), "c": (["b", "a"], F.col("b") + F.col("a")), "bad": (["x"], F.raise_error(F.lit("read")))}
    assert [tuple(r) for r in cone(df, ["x"], formulas, ["c"]).orderBy("x").collect()] == [(0, 3), (1, 6)]
    with pytest.raises(ValueError, match="circle"):
        cone(df, [], {"a": (["b"], F.col("b")), "b": (["a"], F.col("a"))}, ["a"])
    with pytest.raises(ValueError, match="no column"):
        cone(df, [], {"a": (["y"], F.col("y"))}, ["a"])


def test_spills_that_never_settle_raise(spark):
    from loomsheet.operators import spills

    facts = spark.createDataFrame([(1, 1, False)], "anchor int, rows int, blocked boolean")
    with pytest.raises(ValueError, match="settle"):
        spills.repaired(facts, lambda f: f.withColumn("rows", F.col("rows") + 1), most=3)


def test_random_streams_belong_to_cells(spark):
    from loomsheet.functions.volatile import rand, uniform

    def plain(key, seed, draw):
        m = (1 << 64) - 1

        def mix(x):
            x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & m
            x = (x ^ (x >> 27)) * 0x94D049BB133111EB & m
            return x ^ (x >> 31)

        h = 0xCBF29CE484222325
        for b in key.encode():
            h = (h ^ b) * 0x100000001B3 & m
        g = 0x9E3779B97F4A7C15
        state = mix(seed) ^ mix(h)
        return (mix((state + g * (draw + 1)) & m) >> 11) / (1 << 53)

    keys = ["", "A1", "S!R2C3", "é"]
    assert round(float(uniform(["A1"], 42)[0]), 4) == 0.0131
    assert list(uniform(keys, 9, 2)) == [plain(k, 9, 2) for k in keys]
    rows = spark.createDataFrame([(f"k{i}",) for i in range(200)], "k string")
    runs = [{tuple(r) for r in rows.repartition(n).select("k", rand(F.col("k"), 1)).collect()} for n in (1, 5)]
    assert runs[0] == runs[1]


def test_workbook_names(spark):
    from loomsheet.sources.workbook import Workbook

    book = Workbook({"One": spark.range(3).toDF("v"), "Two": spark.range(5).toDF("v")})
    book.define("n", lambda b: b.sheet("ONE"))
    book.define("N", lambda b: b.sheet("two"), scope="Two")
    assert (book.resolve("N").count(), book.resolve("n", "two").count(), book.resolve("n", "One").count()) == (3, 5, 3)
    assert book.sheet("three") is None
    with pytest.raises(KeyError):
        book.resolve("other")
    assert book.span("two", "one", ["v"]).count() == 8
