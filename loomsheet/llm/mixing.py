"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents are permuted by a hash into blocks of about ``block_words`` words. A source's target is met by draws
of blocks: whole passes over its permuted blocks and then a run of them, the last of which is cut between two documents. The
draws of all sources are split among the output shards by a binary tree: at each node a multivariate-hypergeometric draw with
exact sums divides the draws of every source between the halves, and a source's run of draws is cut there. So each shard owns
disjoint draws; what the mix takes of a document is counted over the draws of all shards that fall on its block. In a shard the
documents are shuffled by a hash.

A node's draw is made for at most FAN sources at once: more sources form groups, the draw is made among groups and then inside
each, which is the same distribution. Every step is a row per (node, group), so neither sources nor shards are ever gathered in
one row, and there may be any number of both. A single draw inverts the distribution outwards from its mode, whatever its width;
outcomes farther from it than REACH deviations are rarer than the finest uniform number and are never reached.

Joins that bring a source's plan or a block's draws to the documents are left to Spark, which broadcasts the small tables and
splits skewed sides of the large ones.

Defined cases: a null text has size 0; the null source is a source of its own and sorts last; documents without words are
taken 0 words; rows repeated with one doc_id fall into one block and are taken alike; columns of docs keep their names and
values, whatever they are called; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomsheet.llm.store import stored
from loomsheet.plans import ordered

WEIGHTS = (1, 2, 3)
MOST_PASSES = 3
#: Words of an output shard and of a block, about.
SHARD_WORDS = 1 << 22
BLOCK_WORDS = 50_000
#: Sources, or groups of them, that one draw is made among.
FAN = 64
REACH = 9.0
SEED = 20_240
#: Blocks that share one step of the coarse prefix sum.
_COARSE = 1024
#: Parts that a shard is written by.
_PARTS = 16


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("long")


def _order(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("doc_id"))


def _sources(sized: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """A row per source with its size and target: shares by weight, water-filled below MOST_PASSES times the size."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rows = ordered.addressed(sizes, F.col("source").asc_nulls_last(), name="sid").withColumn("sid", F.col("sid") - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int"))
    most = F.col("source_size") * MOST_PASSES
    rows = rows.withColumns({"weight": weight, "most": most}).withColumn("ratio", F.col("most") / F.col("weight"))
    whole = rows.agg(F.sum("source_size").alias("all"), F.sum("weight").alias("weights"))
    fill = ("ratio", "sid")
    placed = ordered.in_blocks(rows, *fill)
    placed = ordered.scan(placed, fill, "lower", F.sum, F.col("most"), before=True)
    placed = ordered.scan(placed, fill, "spent", F.sum, F.col("weight"), before=True)
    # the level at which this source would be the first that is not full
    level = (F.col("all") - F.coalesce("lower", F.lit(0))) / (F.col("weights") - F.coalesce("spent", F.lit(0)))
    rows = stored(placed.join(F.broadcast(whole)).withColumn("level", level), "source-levels")
    chosen = rows.where("level <= ratio").agg(F.min(F.struct("ratio", "sid", "level"))["level"].alias("chosen"))
    full = F.col("chosen").isNull() | (F.col("ratio") <= F.col("chosen"))
    target = F.when(full, F.col("most").cast("double")).otherwise(F.col("chosen") * F.col("weight"))
    rows = rows.join(F.broadcast(chosen))
    return rows.select("source", "sid", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def _cuts(sized: DataFrame, sources: DataFrame, block_words: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, sid, size, h, block) of the documents, and sources with passes, blocks, quota (the number of draws) and, where
    the last draw is of a part of its block, cut: the order key at which that part ends."""
    full = F.col("source_size") > 0
    passes = F.when(full, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = sources.withColumn("passes", passes).withColumns(
        {
            "rest": F.greatest(F.lit(0.0), F.col("target") - F.col("passes") * F.col("source_size")),
            "blocks": F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_words)).cast("long"),
        }
    )
    plan = stored(plan, "source-plan")
    own = plan.select(F.col("source").alias("s"), "sid", "blocks")
    rows = sized.join(own, F.col("source").eqNullSafe(F.col("s")))
    rows = stored(rows.select("doc_id", "sid", "size", "h", F.pmod("h", "blocks").alias("block")), "block-members")
    sums = rows.groupBy("sid", "block").agg(F.sum("size").alias("words"))
    sums = stored(sums.withColumn("coarse", F.floor(F.col("block") / _COARSE)), "block-sizes")
    # prefix sums in two steps: a source's blocks are never sorted in one task
    coarse = sums.groupBy("sid", "coarse").agg(F.sum("words").alias("sum"))
    upto = W.partitionBy("sid").orderBy("coarse").rowsBetween(W.unboundedPreceding, -1)
    coarse = coarse.select("sid", "coarse", F.coalesce(F.sum("sum").over(upto), F.lit(0)).alias("base"))
    inner = W.partitionBy("sid", "coarse").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.join(coarse, ["sid", "coarse"]).select(
        "sid", "block", "words", (F.col("base") + F.coalesce(F.sum("words").over(inner), F.lit(0))).alias("start")
    )
    rest = plan.select("sid", "rest")
    last = (
        starts.join(rest, "sid")
        .where((F.col("start") < F.col("rest")) & (F.col("rest") <= F.col("start") + F.col("words")))
        .groupBy("sid")
        .agg(F.min(F.struct("block", "start")).alias("last"))
        .select("sid", F.col("last.block").alias("whole"), F.col("last.start").alias("start"))
    )
    last = stored(last, "last-blocks")
    # of the last block take the documents, in hash order, whose middle lies before the cut
    within = W.partitionBy("sid").orderBy("h").rangeBetween(W.unboundedPreceding, -1)
    tail = (
        rows.join(last.withColumnRenamed("whole", "block"), ["sid", "block"])
        .groupBy("sid", "h", "start")
        .agg(F.sum("size").alias("size"))
        .join(rest, "sid")
        .withColumn("at", F.col("start") + F.coalesce(F.sum("size").over(within), F.lit(0)) + F.col("size") / 2)
        .where(F.col("at") <= F.col("rest"))
        .groupBy("sid")
        .agg(F.max("h").alias("cut"))
    )
    plan = plan.join(last.drop("start"), "sid", "left").join(tail, "sid", "left")
    plan = plan.withColumn("whole", F.coalesce("whole", F.when(F.col("rest") > 0, F.col("blocks")).otherwise(0)))
    quota = F.col("passes") * F.col("blocks") + F.col("whole") + F.col("cut").isNotNull().cast("long")
    return rows, stored(plan.withColumn("quota", quota), "mix-plan")


def _unit(*parts: Column) -> Column:
    """A uniform number in (0, 1) from a hash."""
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hypergeometric(units: Column, total: Column, drawn: Column, key: Column) -> Column:
    """How many of ``units`` are among ``drawn`` of ``total``; ``key`` fixes the draw.

    Probabilities relative to the mode's are followed upwards and downwards from it, once for their sum and once to the point
    where they exceed a uniform number.
    """
    num = lambda c: c.cast("double")
    least = F.greatest(F.lit(0).cast("long"), drawn - (total - units))
    most = F.least(units, drawn)
    share = num(units) / num(total)
    deviation = F.sqrt(num(drawn) * share * (1 - share) * num(total - drawn) / F.greatest(F.lit(1.0), num(total - 1)))
    spread = F.struct(
        F.least(most, F.greatest(least, F.floor((num(units) + 1) * (num(drawn) + 1) / (num(total) + 2)))).cast("long").alias("mode"),
        (F.ceil(deviation * REACH) + 40).cast("long").alias("reach"),
    )

    def ratio(x: Column) -> Column:
        """The probability of x + 1 over that of x."""
        return num(units - x) * num(drawn - x) / (num(x + 1) * num(total - units - drawn + x + 1))

    def walk(steps: Column, factor: Callable[[Column], Column], begin: Column, bar: Column, found: Column, to: int) -> Column:
        """Struct(mass, y): the sum over the steps, and the first outcome at which begin and the sum exceed bar."""
        zero = F.struct(F.lit(1.0).alias("w"), begin.alias("mass"), found.alias("y"))
        return F.aggregate(
            steps,
            zero,
            lambda a, x: _let(
                a["w"] * factor(x),
                lambda w: F.struct(
                    w.alias("w"), (a["mass"] + w).alias("mass"), F.when(a["mass"] < bar, x + to).otherwise(a["y"]).alias("y")
                ),
            ),
        )

    def draw(s: Column) -> Column:
        low, high = F.greatest(least, s["mode"] - s["reach"]), F.least(most, s["mode"] + s["reach"])
        none = F.array().cast("array<bigint>")
        up = F.when(high > s["mode"], F.sequence(s["mode"], high - 1)).otherwise(none)
        down = F.when(low < s["mode"], F.sequence(s["mode"] - 1, low)).otherwise(none)
        nowhere, one = F.lit(-1.0), F.lit(1.0)
        above = lambda begin, bar, found: walk(up, ratio, begin, bar, found, 1)
        below = lambda begin, bar, found: walk(down, lambda x: 1 / ratio(x), begin, bar, found, 0)
        masses = F.struct(above(one, nowhere, s["mode"])["mass"].alias("u"), below(F.lit(0.0), nowhere, s["mode"])["mass"].alias("d"))
        return _let(
            masses,
            lambda m: _let(
                _unit(key, F.lit(0)) * (m["u"] + m["d"]),
                lambda bar: F.when(bar <= m["u"], above(one, bar, s["mode"])["y"]).otherwise(
                    below(F.lit(0.0), bar - m["u"], s["mode"])["y"]
                ),
            ),
        )

    return F.when(most <= least, least).otherwise(_let(spread, draw))


def _shared_out(level: DataFrame, seed: int) -> DataFrame:
    """Rows (node, up, drawn, parts: at most FAN of (part, quota)) to (node, part, drawn): the draw among the parts."""
    total = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["quota"])
    state = F.struct(F.col("total").alias("total"), F.col("drawn").alias("drawn"), F.array().cast("array<bigint>").alias("out"))

    def advance(a: Column, p: Column) -> Column:
        """One part: how many of its units are drawn, of what the parts before it have left."""
        key = F.xxhash64(F.lit(seed), F.col("node"), F.col("up"), p["part"])
        return _let(
            hypergeometric(p["quota"], a["total"], a["drawn"], key),
            lambda got: F.struct(
                (a["total"] - p["quota"]).alias("total"),
                (a["drawn"] - got).alias("drawn"),
                F.concat(a["out"], F.array(got)).alias("out"),
            ),
        )

    rows = level.withColumn("total", total).withColumn("drawn", F.coalesce("drawn", F.floor((F.col("total") + F.col("node") % 2) / 2)))
    rows = rows.withColumn("out", F.aggregate("parts", state, advance, lambda a: a["out"]))
    pairs = F.arrays_zip(F.transform("parts", lambda p: p["part"]).alias("part"), F.col("out").alias("drawn"))
    return rows.select("node", F.explode(pairs).alias("p")).select("node", "p.part", "p.drawn")


def split_quotas(quotas: DataFrame, shards: int, seed: int = SEED, fan: int = FAN) -> DataFrame:
    """(sid, quota) to (sid, shard, start, quota): the splitting tree, a level at a time; shards is a power of two.

    A row per (node, source) holds the run of the source's draws that the node owns; the left half gets its front.
    """
    top = quotas.agg(F.max("sid")).first()[0] or 0
    heights = 1
    while fan**heights <= top:
        heights += 1
    rows = quotas.select(F.lit(1).cast("long").alias("node"), "sid", F.lit(0).cast("long").alias("start"), "quota").where("quota > 0")
    for depth in range(shards.bit_length() - 1):
        drawn = None
        for h in reversed(range(heights)):
            part = lambda up, h=h: F.floor(F.col("sid") / fan ** (h + up)).cast("long")
            parts = rows.groupBy("node", part(0).alias("part"), part(1).alias("up")).agg(F.sum("quota").alias("quota"))
            parts = parts.groupBy("node", "up").agg(F.array_sort(F.collect_list(F.struct("part", "quota"))).alias("parts"))
            if drawn is None:
                level = parts.withColumn("drawn", F.lit(None).cast("long"))
            else:
                level = parts.join(drawn.withColumnRenamed("part", "up"), ["node", "up"])
            drawn = _shared_out(level, seed + h)
        left = F.col("drawn")
        halves = F.array(
            F.struct((F.col("node") * 2).alias("node"), F.col("start").alias("start"), left.alias("quota")),
            F.struct((F.col("node") * 2 + 1).alias("node"), (F.col("start") + left).alias("start"), (F.col("quota") - left).alias("quota")),
        )
        rows = rows.join(drawn.withColumnRenamed("part", "sid"), ["node", "sid"]).select("sid", F.explode(halves).alias("half"))
        rows = rows.select("half.node", "sid", "half.start", "half.quota").where("quota > 0")
        rows = stored(rows, f"splitting-tree-{depth}")
    return rows.select("sid", (F.col("node") - shards).alias("shard"), "start", "quota")


def mix_draws(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    shards: int | None = None,
    block_words: int = BLOCK_WORDS,
    seed: int = SEED,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, sid, size, h, block) of the documents, a row of plan per source, and (sid, block, draws): the draws of each
    drawn block, as (copy, shard, cut), cut being null unless only documents up to that order key are taken.

    shards: a power of two; None for as many as it takes to hold about SHARD_WORDS words each.
    """
    if shards is not None and (shards < 1 or shards & (shards - 1)):
        raise ValueError("shards must be a power of two")
    sized = stored(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _order(seed).alias("h")), "sizes"
    )
    members, plan = _cuts(sized, _sources(sized, weights), block_words)
    if shards is None:
        words = plan.agg(F.sum("source_size")).first()[0] or 0
        shards = 1 << max(0, -(-words // SHARD_WORDS) - 1).bit_length()
    parts = split_quotas(plan.select("sid", "quota"), shards, seed)
    draws = parts.select("sid", "shard", F.explode(F.sequence("start", F.col("start") + F.col("quota") - 1)).alias("draw"))
    draws = draws.join(plan.select("sid", "blocks", "cut", (F.col("quota") - 1).alias("last")), "sid")
    cut = F.when(F.col("draw") == F.col("last"), F.col("cut"))
    one = F.struct(F.floor(F.col("draw") / F.col("blocks")).cast("long").alias("copy"), "shard", cut.alias("cut"))
    draws = draws.groupBy("sid", F.pmod("draw", "blocks").alias("block")).agg(F.array_sort(F.collect_list(one)).alias("draws"))
    return members, plan, stored(draws, "block-draws")


def _taken(draws: Column, size: Column, h: Column) -> Column:
    """The draws that take a document of the block."""
    return F.when(size > 0, F.filter(draws, lambda d: d["cut"].isNull() | (h <= d["cut"])))


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken, n_shards: a row per document; n_shards counts the shards that take it."""
    members, plan, draws = mix_draws(docs, **options)
    rows = members.join(draws, ["sid", "block"], "left").join(plan.select("sid", "source_size", "target"), "sid")
    taken = F.coalesce(_taken(F.col("draws"), F.col("size"), F.col("h")), F.array())
    return rows.withColumn("own", taken).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * F.size("own")).alias("taken"),
        F.size(F.array_distinct(F.transform("own", lambda d: d["shard"]))).cast("long").alias("n_shards"),
    )


def mix_documents(docs: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """The mix itself: docs' rows, a row per copy, with mix_shard, mix_copy and mix_order, shuffled within each shard."""
    _, plan, draws = mix_draws(docs, seed=seed, **options)
    own = plan.select(F.col("source").alias("__ls_source"), F.col("sid").alias("__ls_sid"), F.col("blocks").alias("__ls_blocks"))
    rows = docs.select(
        F.struct(*docs.columns).alias("__ls_row"),
        F.col("source").alias("__ls_of"),
        word_count(F.col("text")).alias("__ls_size"),
        _order(seed).alias("__ls_h"),
    )
    rows = rows.join(own, F.col("__ls_of").eqNullSafe(F.col("__ls_source")))
    small = draws.select(F.col("sid").alias("__ls_sid"), F.col("block").alias("__ls_block"), F.col("draws").alias("__ls_draws"))
    rows = rows.withColumn("__ls_block", F.pmod("__ls_h", "__ls_blocks")).join(small, ["__ls_sid", "__ls_block"])
    rows = rows.select("__ls_row", F.explode(_taken(F.col("__ls_draws"), F.col("__ls_size"), F.col("__ls_h"))).alias("__ls_draw"))
    copies = rows.select(
        "__ls_row.*",
        F.col("__ls_draw.copy").alias("mix_copy"),
        F.col("__ls_draw.shard").cast("int").alias("mix_shard"),
        F.xxhash64(F.lit(seed + 1), F.col("__ls_row.doc_id"), F.col("__ls_draw.copy")).alias("mix_order"),
    )
    return copies.repartition("mix_shard", F.pmod("mix_order", F.lit(_PARTS))).sortWithinPartitions("mix_shard", "mix_order")
