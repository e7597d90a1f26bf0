"""N-gram Jaccard join by a MinHash LSH forest.

A document is the set of its SHINGLE-word runs. Documents of equal sets are one class and go on as one row. A class has a
MinHash signature for each tree of the forest, a label of DEPTH values; the labels of a tree are the leaves of a prefix trie.
The prefix is shortened from whole labels until the probability that some tree joins a pair of the threshold's similarity
reaches the target recall (:func:`shortest_prefix`); classes of equal prefixes are the members of a node.

All members of a node meet. Nodes of up to three members give their pairs as rows. The members of larger nodes, the crowds, are
dealt into blocks, and a task compares two blocks at a time: it gives out a row per member with the number of its links and
one link that holds the group together, not a row per pair. A pair that meets in several trees counts in the first of them.
Every candidate is verified on the whole texts, exactly. Links join classes into groups by connected components.

Defined cases: a null text counts as empty; a text of 1 to SHINGLE - 1 words is one run of its words; a text without words
links to nothing, not even another such text; words are runs of 0-9, a-z (A-Z lower-cased) and characters outside ASCII;
rows that repeat are copies of one class; a group takes its least doc_id as class_id (null ids only if it has no other); empty
tables give an empty result; further columns are ignored, or passed through by :func:`keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomsheet.llm import text as T
from loomsheet.llm.components import components
from loomsheet.llm.exact_dedup import without
from loomsheet.llm.store import map_texts, stored

SHINGLE = 5
SIMILARITY = 0.8
TREES = 16
DEPTH = 8
RECALL = 0.995
#: Members of a crowd's block, about, and bytes of their texts.
BLOCK = 512
BLOCK_BYTES = 8 << 20


def shortest_prefix(similarity: float = SIMILARITY, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix, at most depth, at which the trees together join a pair of that similarity with that probability."""
    for length in range(depth, 0, -1):
        if 1 - (1 - similarity**length) ** trees >= recall:
            return length
    raise ValueError("this many trees cannot reach the recall")


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct runs of each row, in order of both."""
    starts, ends, bounds = T.word_bounds(data, offsets)
    words = T.word_hashes(data, starts, ends)
    counts = np.diff(bounds)
    row = np.repeat(np.arange(len(counts)), counts)
    runs = T.run_hash(words, size)
    inside = np.flatnonzero(np.arange(len(runs)) + size <= bounds[row[: len(runs)] + 1])
    rows, values = [row[inside]], [runs[inside]]
    for n in range(1, size):
        short = np.flatnonzero(counts == n)
        if len(short):
            rows.append(short)
            values.append(T.run_hash(words, n, bounds[short]))
    row, value = np.concatenate(rows), np.concatenate(values)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[new], value[new]


def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(11).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_SKETCH = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("k1", pa.int64()),
        ("k2", pa.int64()),
        ("c", pa.int64()),
        ("n", pa.int64()),
        ("bytes", pa.int64()),
        ("nodes", pa.list_(pa.int64())),
    ]
)
_SKETCH_SQL = "doc_id long, k1 long, k2 long, c long, n long, bytes long, nodes array<long>"


def _sketch(trees: int, depth: int, prefix: int, size: int):
    """A row for each text, with the name of its class and of its node in each tree, at that prefix of the labels."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = _multipliers(trees * depth)
        for batch in batches:
            for first, end, data, offsets in T.slices(batch["text"]):
                row, value = shingles(data, offsets, size)
                n = np.bincount(row, minlength=end - first)
                some = np.flatnonzero(n)
                at = np.searchsorted(row, some)
                nodes = np.zeros((end - first, trees), np.uint64)
                nodes += T.mix(np.arange(1, trees + 1, dtype=np.uint64))
                name = np.zeros(end - first, np.uint64)
                if len(some):
                    for t in range(trees):
                        for d in range(prefix):
                            label = np.minimum.reduceat(value * factors[t * depth + d], at) >> np.uint64(32)
                            nodes[some, t] = T.mix(nodes[some, t] ^ (label + np.uint64(d << 40)))
                    name[some] = np.add.reduceat(T.mix(value + np.uint64(1)), at)
                name = T.mix(name + n.astype(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch[c].slice(first, end - first) for c in ("doc_id", "k1", "k2")),
                        pa.array(name.view(np.int64)),
                        pa.array(n.astype(np.int64)),
                        pa.array(np.diff(offsets).astype(np.int64)),
                        T.list_column(np.full(end - first, trees), nodes.reshape(-1).view(np.int64), pa.int64()),
                    ],
                    schema=_SKETCH,
                )

    return made


def candidates(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, tree), a < b, of classes that meet in a node of up to three, with the first such tree; and the members
    (node, tree, c, blocks) of crowds, with the number of blocks of their node."""
    rows = classes.where("n > 0").select("c", "bytes", F.posexplode("nodes").alias("tree", "node"))
    sizes = rows.groupBy("node").agg(
        F.count(F.lit(1)).alias("members"),
        F.sum("bytes").alias("size"),
        F.min("c").alias("first"),
        F.max("c").alias("last"),
        F.min("tree").alias("tree"),
        F.sum(F.xxhash64("c").cast("decimal(20,0)")).alias("who"),
    )
    # stored, so that both sides of the join are dealt for it alone and a node of many members can be split
    sizes = stored(sizes.where("members > 1"), "forest-nodes")
    # of nodes with the same members, all pairs count in the first
    crowds = sizes.where("members > 3").groupBy("members", "who", "size", "first", "last").agg(
        F.min(F.struct("tree", "node"))["node"].alias("node")
    )
    blocks = F.ceil(F.greatest(F.col("members") / BLOCK, F.col("size") / BLOCK_BYTES))
    crowds = stored(crowds.select("node", blocks.cast("long").alias("blocks")), "forest-crowds")
    few = rows.join(sizes.where("members <= 3").drop("tree", "size"), "node")
    few = few.select("c", "tree", F.explode(F.array("first", "last")).alias("leader")).where("c != leader")
    pairs = few.groupBy(F.least("c", "leader").alias("a"), F.greatest("c", "leader").alias("b")).agg(F.min("tree").alias("tree"))
    return stored(pairs, "forest-pairs"), stored(rows.join(crowds, "node").drop("bytes"), "forest-members")


def _together(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The first tree in which the classes of rows of x and y (nodes by tree) meet; the number of trees if they do not."""
    same = x == y
    return np.where(same.any(-1), same.argmax(-1), same.shape[-1])


def _nodes(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _similar(size: int, least: float):
    """Verified links among pairs that do not count in a crowd of an earlier tree."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])

    def sets(column: pa.Array) -> list[np.ndarray]:
        out = []
        for first, end, data, offsets in T.slices(column):
            row, value = shingles(data, offsets, size)
            out += np.split(value, np.searchsorted(row, np.arange(1, end - first)))
        return out

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            # a few pairs at a time: their sets are larger than their texts
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                value = np.zeros(batch.num_rows)
                for i, (x, y) in enumerate(zip(sets(batch["text_a"]), sets(batch["text_b"]), strict=True)):
                    if min(len(x), len(y)) >= least * max(len(x), len(y)):
                        both = len(np.intersect1d(x, y, assume_unique=True))
                        value[i] = both / (len(x) + len(y) - both)
                here = _together(_nodes(batch["nodes_a"]), _nodes(batch["nodes_b"])) == batch["tree"].to_numpy()
                keep = np.flatnonzero((value >= least) & here)
                ids = [batch[c].take(pa.array(keep)) for c in ("a", "b")]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(value[keep])], schema=schema)

    return made


def _common(row: np.ndarray, value: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | int]]:
    """The numbers of values that n sets share, in parts to be added up at (rows, columns): many and a few sets at a time."""
    order = np.argsort(value, kind="stable")
    row, value = row[order], value[order]
    starts = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
    counts = np.diff(np.append(starts, len(value)))
    # a value of many sets is a column of a matrix; one of a few sets gives its pairs
    most = 16 if n > 256 else 1
    many = np.flatnonzero(counts > most)
    for at in range(0, len(many), 2048):
        part = many[at : at + 2048]
        column = np.repeat(np.arange(len(part)), counts[part])
        inside = np.arange(len(column)) - np.repeat(np.cumsum(counts[part]) - counts[part], counts[part])
        has = np.zeros((n, len(part)), np.float32)
        has[row[np.repeat(starts[part], counts[part]) + inside], column] = 1
        every = np.arange(n)
        yield every, every, has @ has.T
    for k in range(2, most + 1):
        at = starts[counts == k]
        for i in range(k):
            for j in range(k):
                yield row[at + i], row[at + j], 1


_CROWD = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("partners", pa.int64())])
_CROWD_SQL = "a long, b long, partners long"


def _crowd(size: int, least: float):
    """Of two blocks of a node (or one with itself): a row for each class with links, the number of documents they lead to,
    and a class that it is held together with (itself for one of each group)."""

    def made(table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        own, c, copies = (table[k].to_numpy() for k in ("tree", "c", "copies"))
        rows, values, done = [], [], 0
        for chunk in table["text"].chunks:
            for first, end, data, offsets in T.slices(chunk):
                row, value = shingles(data, offsets, size)
                rows.append(row + done)
                values.append(value)
                done += end - first
        row, value = np.concatenate(rows), np.concatenate(values)
        n = len(c)
        common = np.zeros((n, n), np.float32)
        for x, y, more in _common(row, value, n):
            if isinstance(more, int):
                np.add.at(common, (x, y), more)
            else:
                common += more
        sizes = np.bincount(row, minlength=n)
        nodes = _nodes(table["nodes"].combine_chunks())
        # in two blocks, pairs within one of them are another task's
        apart = side[:, None] != side if (side != side[0]).any() else ~np.eye(n, dtype=bool)
        apart &= common > 0
        x, y = np.nonzero(np.triu(apart))
        both = common[x, y].astype(np.int64)
        keep = both / (sizes[x] + sizes[y] - both) >= least
        x, y = x[keep], y[keep]
        keep = np.concatenate(
            [np.zeros(0, bool), *(_together(nodes[x[i : i + 65536]], nodes[y[i : i + 65536]]) == own[0] for i in range(0, len(x), 65536))]
        )
        x, y = x[keep], y[keep]
        partners = np.bincount(x, copies[y], n).astype(np.int64) + np.bincount(y, copies[x], n).astype(np.int64)
        # least labels over the links, then labels of labels
        label = np.arange(n)
        while True:
            new = label.copy()
            np.minimum.at(new, x, label[y])
            np.minimum.at(new, y, label[x])
            new = new[new]
            if (new == label).all():
                break
            label = new
        some = np.flatnonzero(partners)
        return pa.Table.from_arrays([pa.array(v) for v in (c[some], c[label[some]], partners[some])], schema=_CROWD)

    return made


def crowd_links(members: DataFrame, bodies: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """Rows (a, b, partners) of :func:`_crowd` over all pairs of blocks of all nodes of many members."""
    block = F.pmod(F.xxhash64(F.lit("block"), "c"), "blocks")
    units = members.select("node", "tree", "c", block.alias("side"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    units = units.select("node", "tree", "c", "side", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"))
    units = units.join(bodies.select("c", "text", "nodes", "copies"), "c")
    return units.groupBy("node", "lo", "hi").applyInArrow(_crowd(shingle, similarity), _CROWD_SQL)


def similar_classes(
    docs: DataFrame,
    similarity: float = SIMILARITY,
    shingle: int = SHINGLE,
    trees: int = TREES,
    depth: int = DEPTH,
    recall: float = RECALL,
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The sketch rows (doc_id, k1, k2, c), the classes (c, copies, rep), the verified links (a, b, similarity) outside crowds
    and the rows (a, b, partners) of crowds: documents that links of a lead to, and a class b of a's group."""
    text = F.coalesce(F.col("text"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    texts = docs.select(
        doc_id.alias("doc_id"), F.xxhash64(text).alias("k1"), F.coalesce(doc_id, F.lit(0)).alias("k2"), text.alias("text")
    )
    # a text without words is a class by its id alone
    prefix = shortest_prefix(similarity, trees, depth, recall)
    sketch = stored(map_texts(texts, _sketch(trees, depth, prefix, shingle), _SKETCH_SQL), "forest-sketches")
    own = F.when(F.col("n") > 0, F.col("c")).otherwise(F.xxhash64(F.lit("empty"), "doc_id", "k1"))
    sketch = sketch.withColumn("c", own)
    classes = sketch.groupBy("c").agg(
        F.count(F.lit(1)).alias("copies"),
        F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "k1", "k2")).alias("rep"),
        F.any_value("n").alias("n"),
        F.max("bytes").alias("bytes"),
        F.any_value("nodes").alias("nodes"),
    )
    classes = stored(classes, "forest-classes")
    pairs, members = candidates(classes)
    met = pairs.select(F.explode(F.array("a", "b")).alias("c")).unionByName(members.select("c")).distinct()
    met = classes.join(met, "c").select("c", F.col("rep.k1").alias("k1"), F.col("rep.k2").alias("k2"))
    # a merge at every size, as these keys grow with the documents; rows that repeat id and text would give a class two texts,
    # one is enough
    bodies = texts.join(stored(met, "forest-met").hint("merge"), ["k1", "k2"]).groupBy("c").agg(F.any_value("text").alias("text"))
    bodies = stored(bodies.join(classes.select("c", "nodes", "copies"), "c"), "forest-texts")
    a, b = (bodies.select(F.col("c").alias(x), *(F.col(y).alias(f"{y}_{x}") for y in ("text", "nodes"))) for x in "ab")
    links = pairs.join(a, "a").join(b, "b").select("a", "b", "tree", "text_a", "text_b", "nodes_a", "nodes_b")
    links = map_texts(links, _similar(shingle, similarity), "a long, b long, similarity double")
    crowds = crowd_links(members, bodies, similarity, shingle)
    return sketch, classes, stored(links, "forest-links"), stored(crowds, "forest-crowd-links")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """A row per document: doc_id, class_id (of its group), copy_id (of its class), n_copies, n_links, and its keys.

    n_links counts the documents that a verified link or an equal set joins to it.
    """
    sketch, classes, links, crowds = similar_classes(docs, **options)
    labels = components(links.select("a", "b").unionByName(crowds.select("a", "b"))).withColumnRenamed("node", "c")
    each = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    sizes = classes.select(F.col("c").alias("b"), "copies")
    partners = each.join(sizes, "b").select("a", F.col("copies").alias("partners")).unionByName(crowds.select("a", "partners"))
    partners = partners.groupBy(F.col("a").alias("c")).agg(F.sum("partners").alias("partners"))
    info = classes.join(labels, "c", "left").join(partners, "c", "left")
    info = info.withColumn("label", F.coalesce("label", "c"))
    groups = info.groupBy("label").agg(F.min("rep").alias("head"))
    info = info.join(groups, "label").select(
        "c", "rep", "head", "copies", (F.coalesce("partners", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    return sketch.join(info, "c").select(
        "doc_id",
        F.col("head.doc_id").alias("class_id"),
        F.col("rep.doc_id").alias("copy_id"),
        F.col("copies").alias("n_copies"),
        "n_links",
        "k1",
        "k2",
        ((F.col("k1") == F.col("head.k1")) & (F.col("k2") == F.col("head.k2"))).alias("kept"),
    )


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs with one document of each group, the one with the least doc_id."""
    names = (F.col("k1").alias("__ls_k1"), F.col("k2").alias("__ls_k2"))
    rows = stored(near_duplicates(docs, **options).select(*names, "kept", "n_copies"), "near-duplicates")
    losers = stored(rows.where("not kept").select("__ls_k1", "__ls_k2").distinct(), "near-losers")
    twice = rows.where("kept and n_copies > 1").groupBy("__ls_k1", "__ls_k2").count().where("count > 1")
    keys = {
        "__ls_k1": F.xxhash64(F.coalesce(F.col("text"), F.lit(""))),
        "__ls_k2": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)),
    }
    return without(docs, keys, losers, stored(twice, "near-twice"))
