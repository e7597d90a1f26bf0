"""Benchmark decontamination by winnowing.

Every text is reduced to fingerprints: of each GUARANTEE - K + 1 consecutive K-gram hashes the least (the leftmost of equal
ones). Two texts that share GUARANTEE words share a fingerprint within them. Fingerprints of documents and of the benchmark
are joined; hits are extended to the runs of GUARANTEE words around them, which must equal a run of the benchmark.

A bit map of fixed size, made from the benchmark's fingerprints, keeps most others from leaving the map side; a bit that is
set by chance only adds a row to the join. Nothing else of the benchmark is held in memory, so it may be of any size.

Words are runs of 0-9, a-z (A-Z lower-cased) and characters outside ASCII. An item of fewer than GUARANTEE words, but not
none, is one run of its own length, and every run of that length in a document is its fingerprint.

Defined cases: null texts have no words; documents that repeat are judged alike, each by its own row; items that repeat an
item_id are one item, and a null item_id is the item "null"; an empty benchmark leaves every document clean; an empty table
gives an empty result; further columns are ignored, or passed through by :func:`drop_contaminated`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomsheet.llm import text as T
from loomsheet.llm.store import map_texts, stored

K = 5
GUARANTEE = 10
#: log2 of the bits of the map, 2 MB.
MAP_BITS = 24
_SIGNED = np.int64


def _argmin(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of width values the index of the least, the leftmost of equal ones."""
    n = max(0, len(values) - width + 1)
    best = values[:n].copy()
    at = np.arange(n)
    for j in range(1, width):
        less = values[j : j + n] < best
        best[less] = values[j : j + n][less]
        at[less] = np.flatnonzero(less) + j
    return at


def fingerprints(words: np.ndarray, bounds: np.ndarray, k: int, guarantee: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of the fingerprints; bounds has each row's first word, and the end."""
    grams = T.run_hash(words, k)
    at = _argmin(grams, guarantee - k + 1)
    ends = np.repeat(bounds[1:], np.diff(bounds))[: len(at)]
    at = np.unique(at[np.arange(len(at)) + guarantee <= ends])
    return at, grams[at]


def _short_runs(words: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    hashes = T.run_hash(words, length)
    ends = np.repeat(bounds[1:], np.diff(bounds))[: len(hashes)]
    at = np.flatnonzero(np.arange(len(hashes)) + length <= ends)
    return at, hashes[at]


def _words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for first, end, data, offsets in T.slices(column):
        starts, ends, bounds = T.word_bounds(data, offsets)
        yield first, end, T.word_hashes(data, starts, ends), bounds


_ITEM = pa.schema([("item", pa.string()), ("length", pa.int32()), ("run", pa.int64()), ("print", pa.int64())])


def _item_runs(k: int, guarantee: int):
    """All runs of each item, with a null fingerprint, and all its fingerprints, with a null run."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, words, bounds in _words(batch["text"]):
                counts = np.diff(bounds)
                out: list[tuple[np.ndarray, int, np.ndarray, bool]] = []
                row_of = np.repeat(np.arange(len(counts)), counts)
                runs = T.run_hash(words, guarantee)
                at = np.flatnonzero(np.arange(len(runs)) + guarantee <= bounds[row_of[: len(runs)] + 1])
                out.append((row_of[at], guarantee, runs[at], False))
                at, prints = fingerprints(words, bounds, k, guarantee)
                out.append((row_of[at], guarantee, prints, True))
                for length in range(1, guarantee):
                    rows = np.flatnonzero(counts == length)
                    if len(rows):
                        hashes = T.run_hash(words, length, bounds[rows])
                        out += [(rows, length, hashes, False), (rows, length, hashes, True)]
                items = batch["item"]
                for rows, length, hashes, is_print in out:
                    values = pa.array(hashes.view(_SIGNED))
                    none = pa.nulls(len(rows), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [
                            items.take(pa.array(rows + first)),
                            pa.array(np.full(len(rows), length, np.int32)),
                            none if is_print else values,
                            values if is_print else none,
                        ],
                        schema=_ITEM,
                    )

    return made


_DOC = pa.schema(
    [
        ("key", pa.int64()),
        ("row", pa.int64()),
        ("n_words", pa.int64()),
        ("prints", pa.list_(pa.int64())),
        ("lengths", pa.list_(pa.int32())),
        ("starts", pa.list_(pa.int32())),
        ("runs", pa.list_(pa.int64())),
    ]
)


def _doc_prints(bits, short: list[int], k: int, guarantee: int):
    """A row per document: its fingerprints that the bit map holds, and the hashes of the runs around each."""
    around = guarantee - k + 1

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bits.value
        key = TaskContext.get().partitionId() << 40

        def held(hashes: np.ndarray) -> np.ndarray:
            slot = (hashes >> np.uint64(64 - MAP_BITS)).astype(np.int64)
            return (table[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1

        for batch in batches:
            for first, end, words, bounds in _words(batch["text"]):
                counts = np.diff(bounds)
                row_of = np.repeat(np.arange(len(counts)), counts)
                parts = []
                at, prints = fingerprints(words, bounds, k, guarantee)
                at, prints = at[keep := held(prints)], prints[keep]
                if len(at):
                    low = np.maximum(at - (around - 1), bounds[row_of[at]])
                    starts = low[:, None] + np.arange(around)
                    good = (starts <= at[:, None]) & (starts + guarantee <= bounds[row_of[at] + 1][:, None])
                    runs = np.zeros(starts.shape, np.uint64)
                    runs[good] = T.run_hash(words, guarantee, starts[good])
                    parts.append((row_of[at], prints, np.full(len(at), guarantee), low, runs))
                for length in short:
                    at, prints = _short_runs(words, bounds, length)
                    at, prints = at[keep := held(prints)], prints[keep]
                    runs = np.zeros((len(at), around), np.uint64)
                    runs[:, 0] = prints
                    parts.append((row_of[at], prints, np.full(len(at), length), at, runs))
                rows = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
                order = np.argsort(rows, kind="stable")
                each = np.bincount(rows, minlength=end - first)
                pick = lambda i, t: np.concatenate([p[i] for p in parts])[order] if parts else np.zeros(0, t)  # noqa: E731, B023
                start = pick(3, np.int64) - bounds[rows[order]]
                runs = np.concatenate([p[4] for p in parts])[order] if parts else np.zeros((0, around), np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(key, key + end - first)),
                        batch["row"].slice(first, end - first),
                        pa.array(counts.astype(np.int64)),
                        T.list_column(each, pick(1, np.uint64).view(_SIGNED), pa.int64()),
                        T.list_column(each, pick(2, np.int64).astype(np.int32), pa.int32()),
                        T.list_column(each, start.astype(np.int32), pa.int32()),
                        T.list_column(each * around, runs.ravel().view(_SIGNED), pa.int64()),
                    ],
                    schema=_DOC.set(1, batch.schema.field("row")),
                )
                key += end - first

    return made


def _bit_map(prints: DataFrame) -> np.ndarray:
    """The map's set bits, gathered as at most 2**(MAP_BITS - 6) words."""
    slots = prints.select(F.shiftrightunsigned("print", 64 - MAP_BITS).alias("slot"))
    words = slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(slot % 64 as int)))").alias("bits")
    )
    table = np.zeros(1 << (MAP_BITS - 6), np.uint64)
    for word, bits in words.collect():
        table[word] = bits % (1 << 64)
    return table.view(np.uint8)


def find_contaminated(
    docs: DataFrame, benchmark: DataFrame, k: int = K, guarantee: int = GUARANTEE, id_column: str = "doc_id"
) -> DataFrame:
    """A row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans (of hit words, end exclusive)."""
    spark = docs.sparkSession
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.coalesce("text", F.lit("")).alias("text")
    )
    items = stored(map_texts(items, _item_runs(k, guarantee), "item string, length int, run long, print long"), "item-runs")
    prints = items.where("print is not null").select("print").distinct()
    short = [r[0] for r in items.where(f"length < {guarantee}").select("length").distinct().collect()]
    bits = spark.sparkContext.broadcast(_bit_map(prints))
    # the items of a run, named by a hash that needs no list of them; a passage's runs share one set
    pairs = items.where("run is not null").select("run", "length", "item").distinct()
    sets = pairs.groupBy("run", "length").agg(
        F.struct(F.count(F.lit(1)), F.bit_xor(F.xxhash64("item")), F.bit_xor(F.xxhash64(F.lit(1), "item"))).alias("items")
    )
    sets = stored(sets.withColumn("items", F.xxhash64("items")), "item-sets")
    of_set = sets.groupBy("items").agg(F.min(F.struct("run", "length")).alias("one"))
    of_set = of_set.join(pairs, (F.col("one.run") == F.col("run")) & (F.col("one.length") == F.col("length")))

    own = F.col(id_column) if dict(docs.dtypes)[id_column].startswith("struct") else F.col(id_column).cast("long")
    texts = docs.select(own.alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    schema = f"key long, row {dict(texts.dtypes)['row']}, n_words long, prints array<long>, lengths array<int>, starts array<int>, runs array<long>"
    found = stored(map_texts(texts, _doc_prints(bits, sorted(short), k, guarantee), schema), "doc-prints")
    around = guarantee - k + 1
    hits = (
        found.where(F.size("prints") > 0)
        .select("key", "lengths", "starts", "runs", F.posexplode("prints").alias("i", "print"))
        .select(
            "key",
            "print",
            F.get("lengths", F.col("i")).alias("length"),
            F.get("starts", F.col("i")).alias("start"),
            F.slice("runs", F.col("i") * around + 1, F.lit(around)).alias("runs"),
        )
        .join(prints, "print", "left_semi")
        .select("key", "length", "start", F.posexplode("runs").alias("j", "run"))
        .where("run != 0")
        .select("key", "length", (F.col("start") + F.col("j")).alias("start"), "run")
    )
    matched = stored(hits.join(sets, ["run", "length"]).select("key", "start", "length", "items").distinct(), "run-hits")
    spans = F.aggregate(
        F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("end")))),
        F.array().cast("array<struct<start:int,end:int>>"),
        _merged,
    )
    covered = matched.groupBy("key").agg(spans.alias("spans"))
    named = (
        matched.select("key", "items")
        .distinct()
        .join(of_set.select("items", "item"), "items")
        .groupBy("key")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    both = covered.join(named, "key")
    none = F.array().cast("array<struct<start:int,end:int>>")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]))
    result = found.select("key", F.col("row").alias(id_column), "n_words").join(both, "key", "left")
    result = result.withColumn("spans", F.coalesce("spans", none)).withColumn("n_hit", n_hit)
    return result.select(
        id_column,
        "n_words",
        "n_hit",
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")).cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        "spans",
        "key",
    )


def _merged(done, span):
    """Sorted spans, those that meet or overlap joined."""
    last = F.element_at(done, -1)
    joined = F.concat(
        F.slice(done, 1, F.size(done) - 1),
        F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"))),
    )
    return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= span["start"]), joined).otherwise(
        F.concat(done, F.array(span))
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the documents that hold a run of the benchmark. Verdicts follow the text, by a hash of 128 bits."""
    text = F.coalesce("text", F.lit(""))
    key = F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))
    found = find_contaminated(docs.select(key.alias("__ls_text"), "text"), benchmark, id_column="__ls_text", **options)
    # stored, so that Spark knows its size and need not move texts for a small one
    bad = stored(found.where("contaminated").select(F.col("__ls_text.a").alias("__ls_a"), F.col("__ls_text.b").alias("__ls_b")).distinct(), "contaminated")
    own = docs.withColumns({"__ls_a": F.xxhash64(text), "__ls_b": F.xxhash64(F.lit(1), text)})
    return own.join(bad, ["__ls_a", "__ls_b"], "left_anti").drop("__ls_a", "__ls_b")
