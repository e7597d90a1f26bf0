"""Dependency graphs as tables: dirty closures, cycle groups and iterative values, by joins whose lineage is cut each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomsheet.sources.tables import stored


def _walked(edges: DataFrame, heads: DataFrame) -> DataFrame:
    """(node, head, steps, least) of the nodes inside chains: they have one edge in, from a node with one edge out, and are no
    heads. least is the least node from node back to before head.

    Pointers to the node before are doubled, so a chain of n nodes takes log2(n) rounds. Rings of such nodes reach no head: their
    head is a node of the ring, and least the ring's least.
    """
    into = edges.groupBy(F.col("target").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("source").alias("head"))
    out = edges.groupBy(F.col("source").alias("head")).agg(F.count(F.lit(1)).alias("m"))
    inner = into.where("n = 1").join(out.where("m = 1"), "head").where("node != head")
    inner = inner.join(heads.select("node"), "node", "left_anti")
    links = stored(inner.select("node", "head", F.lit(1).cast("long").alias("steps"), F.col("node").alias("least")), "chains")
    n = links.count()
    for _ in range(n.bit_length() + 1 if n else 0):
        via = links.select(
            F.col("node").alias("head"), F.col("head").alias("__next"), F.col("steps").alias("__more"), F.col("least").alias("__least")
        )
        new = links.join(via, "head", "left").select(
            "node",
            F.coalesce("__next", "head").alias("head"),
            (F.col("steps") + F.coalesce("__more", F.lit(0))).alias("steps"),
            F.least("least", "__least").alias("least"),
            F.col("__next").isNotNull().alias("__moved"),
        )
        new = stored(new, "chains")
        links = new.drop("__moved")
        if not new.where("__moved").head(1):
            break
    return links


def _chains(edges: DataFrame, heads: DataFrame) -> DataFrame:
    """(node, head, steps) of the nodes inside chains; those on rings of such nodes are left out."""
    links = _walked(edges, heads)
    return links.join(links.select(F.col("node").alias("head")), "head", "left_anti").select("node", "head", "steps")


def closure(edges: DataFrame, seeds: DataFrame, most: int = 10_000) -> DataFrame:
    """(node, depth): what is reached from seeds(node) along edges(source, target), with its least distance, seeds at depth 0.

    Chains are walked by doubled pointers; frontiers are then joined over what is left of the graph, where each edge may stand for
    a chain.
    """
    edges = edges.select("source", "target").distinct()
    start = seeds.select("node").distinct()
    chains = _chains(edges, start)
    side = chains.select(F.col("node").alias("source"), "head", "steps")
    short = edges.join(chains.select(F.col("node").alias("target")), "target", "left_anti").join(side, "source", "left")
    short = short.select(F.coalesce("head", "source").alias("source"), "target", (F.coalesce("steps", F.lit(0)) + 1).alias("steps"))
    short = stored(short.groupBy("source", "target").agg(F.min("steps").alias("steps")), "closure-short")
    reached = front = stored(start.withColumn("depth", F.lit(0).cast("long")), "closure")
    for i in range(most):
        new = short.join(front, short["source"] == front["node"]).groupBy(short["target"].alias("node"))
        new = new.agg(F.min(F.col("steps") + F.col("depth")).alias("depth"))
        known = reached.groupBy("node").agg(F.min("depth").alias("__was"))
        front = new.join(known, "node", "left").where(F.col("__was").isNull() | (F.col("depth") < F.col("__was"))).select("node", "depth")
        front = stored(front, "closure")
        if not front.head(1):
            break
        reached = reached.unionByName(front)
        if i % 8 == 7:
            reached = stored(reached.groupBy("node").agg(F.min("depth").alias("depth")), "closure")
    else:
        raise ValueError(f"not closed after {most} rounds")
    reached = reached.groupBy("node").agg(F.min("depth").alias("depth"))
    along = chains.join(reached.withColumnRenamed("node", "head"), "head").select("node", (F.col("depth") + F.col("steps")).alias("depth"))
    return reached.unionByName(along)


def _spread(edges: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """labels(node, label) after the least label has gone along the edges as far as it can."""
    for _ in range(most):
        come = edges.join(labels, edges["source"] == labels["node"]).groupBy(edges["target"].alias("node")).agg(F.min("label").alias("__new"))
        new = labels.join(come, "node", "left").select("node", F.least("label", "__new").alias("label"), (F.col("__new") < F.col("label")).alias("__less"))
        new = stored(new, "cycle-labels")
        labels = new.select("node", "label")
        if not new.where("__less").head(1):
            return labels
    raise ValueError(f"not settled after {most} steps")


def cycle_groups(edges: DataFrame, most: int = 10_000) -> DataFrame:
    """(node, group): the strongly connected groups of two nodes and more, or of one that refers to itself; group is its least node.

    A node inside a chain is on a cycle where the chain's head is, so chains and plain rings are walked by doubled pointers, and
    the rounds see the heads only. Each round takes off nodes without edges in or out, sends least labels forwards, and takes for
    a group the nodes of a label that its own node can be reached from; edges between different labels go, as they are on no cycle.
    """
    edges = stored(edges.select("source", "target").distinct(), "cycles")
    links = _walked(edges, edges.select(F.col("source").alias("node")).limit(0))
    inner = links.select(F.col("node").alias("head"))
    rings = links.join(inner, "head", "left_semi").select("node", F.col("least").alias("group"))
    chains = links.join(inner, "head", "left_anti").select("node", "head")
    short = edges.join(links.select(F.col("node").alias("target")), "target", "left_anti")
    short = short.join(chains.withColumnRenamed("node", "source"), "source", "left")
    short = stored(short.select(F.coalesce("head", "source").alias("source"), "target").distinct(), "cycles")
    heads = _groups_of_heads(short, most)
    if heads is None:
        return rings
    rows = heads.unionByName(chains.join(heads.withColumnRenamed("node", "head"), "head").select("node", "group"))
    least = rows.groupBy("group").agg(F.min("node").alias("__least"))
    return rows.join(least, "group").select("node", F.col("__least").alias("group")).unionByName(rings)


def _groups_of_heads(edges: DataFrame, most: int) -> DataFrame | None:
    """cycle_groups of a graph without chains; None where it has no cycle."""
    left = edges
    found = None
    for _ in range(most):
        size = left.count()
        while size:
            inner = left.select(F.col("target").alias("node")).intersect(left.select(F.col("source").alias("node")))
            kept = left.join(inner, left["source"] == inner["node"], "left_semi")
            left = stored(kept.join(inner, kept["target"] == inner["node"], "left_semi"), "cycles")
            if (now := left.count()) == size:
                break
            size = now
        if not size:
            break
        nodes = left.select(F.col("source").alias("node")).union(left.select("target")).distinct()
        labels = _spread(left, stored(nodes.withColumn("label", F.col("node")), "cycle-labels"), most)
        a, b = labels.select(F.col("node").alias("source"), F.col("label").alias("__a")), labels.select(F.col("node").alias("target"), F.col("label").alias("__b"))
        same = stored(left.join(a, "source").join(b, "target").where("__a = __b").select("source", "target"), "cycles")
        back = same.select(F.col("target").alias("source"), F.col("source").alias("target"))
        # from the node that gave the label, backwards
        own = labels.where("node = label")
        group = closure(back, own.select("node")).select("node").join(labels, "node").select("node", F.col("label").alias("group"))
        group = stored(group, "cycle-groups")
        found = group if found is None else found.unionByName(group)
        done = group.select("node")
        left = same.join(done, same["source"] == done["node"], "left_anti")
        left = stored(left.join(done, left["target"] == done["node"], "left_anti"), "cycles")
    else:
        raise ValueError(f"not settled after {most} rounds")
    if found is None:
        return None
    # a label's own node is a group by itself unless it lies on a cycle
    several = found.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    alone = edges.where("source = target").select(F.col("source").alias("node")).distinct().withColumn("__self", F.lit(True))
    rows = found.join(several, "group").join(alone, "node", "left").where("n > 1 or __self")
    return rows.select("node", "group")


def invalidated(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, state, reasons): seeds(node, reason) with their reasons, what depends on them as UpstreamPublication, and members of
    cycles among these, and what depends on such members, as CycleBlocked."""
    reached = closure(edges, seeds.select("node")).select("node")
    groups = cycle_groups(edges).select("node")
    members = reached.join(groups, "node", "left_semi")
    stuck = closure(edges, members).select("node").withColumn("__stuck", F.lit(True))
    given = seeds.groupBy("node").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
    rows = reached.join(given, "node", "left").join(stuck, "node", "left")
    state = F.when(F.col("__stuck"), "CycleBlocked").when(F.col("reasons").isNotNull(), "Seed").otherwise("UpstreamPublication")
    return rows.select("node", state.alias("state"), F.array_join(F.coalesce("reasons", F.array().cast("array<string>")), ",").alias("reasons"))


def jacobi(cells: DataFrame, links: DataFrame, most: int = 100, change: float = 0.001) -> DataFrame:
    """Iterate value = base + sum(weight * value of source) from the previous values until no value moves by more than change.

    cells(node, base, value), links(source, target, weight). Raises where it does not settle.
    """
    now = stored(cells.select("node", "base", "value"), "jacobi")
    for _ in range(most):
        pull = links.join(now, links["source"] == now["node"]).groupBy(F.col("target").alias("node"))
        pull = pull.agg(F.sum(F.col("weight") * F.col("value")).alias("pull"))
        new = now.join(pull, "node", "left").select(
            "node", "base", (F.col("base") + F.coalesce("pull", F.lit(0.0))).alias("value"), F.col("value").alias("was")
        )
        new = stored(new, "jacobi")
        now = new.select("node", "base", "value")
        if (new.agg(F.max(F.abs(F.col("value") - F.col("was")))).first()[0] or 0) <= change:
            return now.select("node", "value")
    raise ValueError(f"no fixed point after {most} rounds")
