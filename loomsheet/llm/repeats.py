"""Removal of repeated byte strings by bucket-pointer refinement of sampled suffixes.

A byte goes if a string of LENGTH bytes that covers it also starts anywhere else, in the same text or another.

Suffixes are put into initial buckets by a Q-gram and buckets are refined by identifiers of the buckets at later offsets,
as in bucket-pointer refinement; a bucket of one suffix is final and its suffix leaves. So that the suffixes need not all be
moved, every string of LENGTH bytes is represented by one suffix in it, its anchor: the start of its least Q-gram hash, the
leftmost of equal ones. Equal strings have equal anchors at equal offsets, so no repeat is missed. Neighbouring strings
share an anchor, and one row stands for such a run of starts.

1. Buckets of one anchor leave: none of their strings repeats.
2. Anchors of a bucket whose runs are equal as a whole, start to end, are one class; a class of several repeats wholly.
3. Where a bucket has several classes, one member of each is refined: its run is cut at fixed offsets from the anchor into
   pieces of at most PIECE starts. The bytes common to a piece's strings name a bucket (alone in it: no string of the piece
   repeats) and all bytes of the piece name another (in company: every string of the piece repeats). What is left open is
   refined to single strings.

Identifiers are hashes of the bytes themselves, so buckets at different executors agree without exchange of ranks; what counts as
equal has the 64 bits of its initial bucket and 64 bits of its own.

Runs of a text that are equal to each other are put together where the text is read: one row stands for them with their number,
and the bytes that they cover, merged, are repeated in any case. So a text of one character is a few rows and not one a byte.

Defined cases: a null text counts as empty; texts shorter than LENGTH lose nothing; a text that several rows share is repeated
at each of them; empty tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomsheet.llm import text as T
from loomsheet.llm.store import map_texts, stored

LENGTH = 400
Q = 128
PIECE = 16
#: Starts handled at once in a long text.
CHUNK = 1 << 22
_POS = np.uint64((1 << 24) - 1)

#: n: how often the run stands in its text; 0 for bytes lo to before hi that are known to repeat.
_ANCHOR = "bucket long, run long, n long, k1 long, k2 long, p int, lo int, hi int"


def _arrow(fields: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[k]) for n, k in (f.split() for f in fields.split(", "))])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each width consecutive values: minima up to and from block borders, two passes."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    padded = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    up = np.minimum.accumulate(blocks, axis=1).ravel()
    down = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(down[:n], up[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, q: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, bucket, run, p, lo, hi), positions counted in the row, for each run of starts with one anchor."""
    for base in range(0, max(1, len(data) - length + 1), CHUNK):
        part = data[base : base + CHUNK + length - 1]
        if len(part) < length:
            return
        at = np.arange(q, len(part) + 1)
        h = T.prefix_hash(part)
        grams = T.span_hash(h, at - q, at)
        least = sliding_min((grams & ~_POS) | (at - q).astype(np.uint64), length - q + 1)
        # starts whose string ends in their own row
        row = np.searchsorted(offsets, np.arange(base, base + len(least)), "right") - 1
        start = np.flatnonzero(np.arange(base, base + len(least)) + length <= offsets[row + 1])
        if not len(start):
            continue
        p = (least[start] & _POS).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], (np.diff(p) != 0) | (np.diff(start) != 1)]))
        lo, hi, p = start[first], start[np.append(first[1:], len(start)) - 1], p[first]
        shape = ((p - lo) * (2 * length) + (hi - lo)).astype(np.uint64)
        run = T.mix(T.span_hash(h, lo, hi + length) ^ T.mix(shape))
        row = row[lo]
        shift = base - offsets[row]
        yield row, grams[p], run, p + shift, lo + shift, hi + shift


def _merged(row: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans [lo, hi) of rows, in order, those that meet or overlap joined."""
    order = np.lexsort((lo, row))
    row, lo, hi = row[order], lo[order], hi[order]
    # rows apart by more than any length, so that one running maximum does for all of them
    wide = np.int64(1) << 40
    top = np.maximum.accumulate(row * wide + hi)
    first = np.append(True, row[1:] * wide + lo[1:] > top[:-1]) if len(row) else np.zeros(0, bool)
    last = np.append(first[1:], True) if len(row) else first
    return row[first], lo[first], top[last] - row[last] * wide


def _together(row: np.ndarray, bucket: np.ndarray, run: np.ndarray, p: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int):
    """One row for the equal runs of a text, with their number, and the merged bytes of runs that are not alone in it."""
    order = np.lexsort((lo, run, bucket, row))
    row, bucket, run, p, lo, hi = (x[order] for x in (row, bucket, run, p, lo, hi))
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (bucket[1:] != bucket[:-1]) | (run[1:] != run[:-1])
    group = np.cumsum(new) - 1
    n = np.bincount(group)
    again = n[group] > 1
    cover, start, end = _merged(row[again], lo[again], hi[again] + length)
    none = np.zeros(len(cover), np.uint64)
    parts = (
        (row[new], cover),
        (bucket[new], none),
        (run[new], none),
        (n, np.zeros(len(cover), np.int64)),
        (p[new], start),
        (lo[new], start),
        (hi[new], end),
    )
    return (np.concatenate(x) for x in parts)


def _scan(length: int, q: int):
    schema = _arrow(_ANCHOR)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = batch["k1"], batch["k2"]
            for first, _, data, offsets in T.slices(batch["text"]):
                for found in anchors(data, offsets, length, q):
                    row, bucket, run, n, *spots = _together(*found, length)
                    rows = pa.array(row + first)
                    columns = [pa.array(bucket.view(np.int64)), pa.array(run.view(np.int64)), pa.array(n.astype(np.int64))]
                    columns += [k1.take(rows), k2.take(rows), *(pa.array(s.astype(np.int32)) for s in spots)]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return made


_REP = "bucket long, n long, k1 long, k2 long, p int, lo int, hi int"


def _cut(length: int):
    """The bytes of each member's run, from its text: rows of _REP's fields and the bytes."""
    schema = _arrow(_REP).append(pa.field("bytes", pa.binary()))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists = batch["text"].cast(pa.large_binary()), batch["reps"]
            for i in range(len(texts)):
                raw = texts[i].as_buffer()
                reps = lists[i].as_py()
                columns = [[r[n] for r in reps] for n in ("bucket", "n")]
                columns += [[batch[k][i].as_py()] * len(reps) for k in ("k1", "k2")]
                columns += [[r[n] for r in reps] for n in ("p", "lo", "hi")]
                columns.append([raw[r["lo"] : r["hi"] + length].to_pybytes() for r in reps])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
                )

    return made


_PIECE = "bucket long, n long, k1 long, k2 long, p int, lo int, hi int, core long, whole long"


def _pieces(length: int, piece: int):
    """The pieces of each member's run with the hashes of their common and of all bytes."""
    schema = _arrow(_PIECE)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket, n, k1, k2, p, lo, hi = (batch[c].to_numpy() for c in ("bucket", "n", "k1", "k2", "p", "lo", "hi"))
            for first, end, data, offsets in T.slices(batch["bytes"]):
                h = T.prefix_hash(data)
                s = slice(first, end)
                at, low, high = p[s].astype(np.int64), lo[s].astype(np.int64), hi[s].astype(np.int64)
                g0, g1 = (at - high) // piece, (at - low) // piece
                rep = np.repeat(np.arange(end - first), g1 - g0 + 1)
                g = np.arange(len(rep)) - np.repeat(np.cumsum(g1 - g0 + 1) - (g1 - g0 + 1), g1 - g0 + 1) + g0[rep]
                shift = offsets[:-1][rep] - low[rep]
                core_at = at[rep] - piece * g
                core = T.span_hash(h, core_at + shift, core_at - (piece - 1) + length + shift)
                a, b = np.maximum(low[rep], core_at - (piece - 1)), np.minimum(high[rep], core_at)
                whole = T.span_hash(h, a + shift, b + length + shift)
                group = bucket[s][rep].view(np.uint64)
                core = T.mix(core ^ T.mix(group + g.astype(np.uint64)))
                whole = T.mix(whole ^ T.mix(core + ((core_at - a) * piece + (core_at - b)).astype(np.uint64)))
                columns = [bucket[s][rep], n[s][rep], k1[s][rep], k2[s][rep], p[s][rep], a.astype(np.int32), b.astype(np.int32)]
                columns += [core.view(np.int64), whole.view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

    return made


_STRING = "bucket long, n long, k1 long, k2 long, at int, string long"


def _strings(length: int):
    """The single strings of open pieces: lists of (lo, hi) beside the bytes of the run they lie in."""
    schema = _arrow(_STRING)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in T.slices(batch["bytes"]):
                h = T.prefix_hash(data)
                spans = batch["open"].slice(first, end - first)
                row = np.repeat(np.arange(first, end), spans.value_lengths().to_numpy())
                flat = spans.flatten()
                a, b = flat.field("lo").to_numpy().astype(np.int64), flat.field("hi").to_numpy().astype(np.int64)
                each = np.repeat(np.arange(len(a)), b - a + 1)
                start = np.arange(len(each)) - np.repeat(np.cumsum(b - a + 1) - (b - a + 1), b - a + 1) + a[each]
                row = row[each]
                shift = offsets[row - first] - batch["lo"].to_numpy().astype(np.int64)[row]
                value = T.span_hash(h, start + shift, start + shift + length)
                columns = [batch[c].to_numpy()[row] for c in ("bucket", "n", "k1", "k2")]
                columns += [start.astype(np.int32), value.view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

    return made


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, repeated boolean"


def _removal(with_text: bool):
    schema = _arrow(_RESULT)
    if with_text:
        schema = schema.append(pa.field("kept", pa.binary()))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids, spans = batch["text"].cast(pa.large_binary()), batch["doc_id"], batch["spans"].fill_null([])
            flat = spans.flatten()
            row = np.repeat(np.arange(len(texts)), spans.value_lengths().to_numpy())
            row, lo, hi = _merged(row, *(flat.field(k).to_numpy().astype(np.int64) for k in ("lo", "hi")))
            bounds = np.searchsorted(row, np.arange(len(texts) + 1))
            rows = []
            for i in range(len(texts)):
                raw, own = texts[i].as_buffer(), slice(bounds[i], bounds[i + 1])
                removed = int((hi[own] - lo[own]).sum())
                digest, kept, last = hashlib.sha256(), [], 0
                for a, b in zip([*lo[own].tolist(), raw.size], [*hi[own].tolist(), raw.size], strict=True):
                    digest.update(raw[last:a])
                    if with_text:
                        kept.append(raw[last:a])
                    last = b
                result = (ids[i].as_py(), raw.size, removed, len(lo[own]), digest.hexdigest(), removed > 0)
                rows.append((*result, b"".join(kept)) if with_text else result)
            columns = zip(zip(*rows, strict=True) if rows else [()] * len(schema), schema, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in columns], schema=schema)

    return made


def _keyed(docs: DataFrame) -> DataFrame:
    """Texts keyed by hash and id. Rows with one key hold one text, so they lose the same bytes."""
    text: Column = F.coalesce(F.col("text"), F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("k1"), key.alias("k2"))


def repeated_spans(texts: DataFrame, length: int = LENGTH, q: int = Q, piece: int = PIECE) -> DataFrame:
    """(k1, k2, lo, hi): bytes covered by strings of ``length`` bytes that start more than once, possibly overlapping."""
    piece = max(1, min(piece, length // 4))
    long_texts = texts.where(F.octet_length("text") >= length).select("text", "k1", "k2")
    found = stored(map_texts(long_texts, _scan(length, q), _ANCHOR), "anchors")
    known = found.where("n = 0").select("k1", "k2", "lo", "hi")
    found = found.where("n > 0")
    # stored, so that both sides of the join are dealt for it alone and a bucket that many texts share can be split
    live = stored(found.groupBy("bucket").agg(F.sum("n").alias("n")).where("n > 1").select("bucket"), "anchors-live")
    members = stored(found.join(live, "bucket"), "anchors-met")
    place = F.struct("k1", "k2", "p", "lo", "hi")
    classes = members.groupBy("bucket", "run").agg(F.sum("n").alias("n"), F.min(place).alias("one"))
    classes = stored(classes, "anchor-classes")
    whole = members.where("n = 1").join(classes.where("n > 1").select("bucket", "run"), ["bucket", "run"])
    whole = whole.select("k1", "k2", "lo", (F.col("hi") + length).alias("hi"))

    several = classes.groupBy("bucket").count().where("count > 1").select("bucket")
    reps = classes.join(several, "bucket").select("bucket", "n", "one.*")
    reps = reps.groupBy("k1", "k2").agg(F.collect_list(F.struct("bucket", "n", "p", "lo", "hi")).alias("reps"))
    cut = map_texts(long_texts.join(reps, ["k1", "k2"]), _cut(length), f"{_REP}, bytes binary")
    cut = stored(cut, "anchor-bytes")
    pieces = stored(map_texts(cut, _pieces(length, piece), _PIECE), "anchor-pieces")
    cores = pieces.groupBy("bucket", "core").agg(F.sum("n").alias("n"), F.min("whole").alias("a"), F.max("whole").alias("b"))
    wholes = pieces.groupBy("bucket", "whole").agg(F.sum("n").alias("n"), F.min("n").alias("least"))
    by_piece = wholes.where("n > 1 and least = 1").select("bucket", "whole")
    by_piece = pieces.where("n = 1").join(by_piece, ["bucket", "whole"])
    by_piece = by_piece.select("k1", "k2", "lo", (F.col("hi") + length).alias("hi"))

    unlike = cores.where("n > 1 and a != b").select("bucket", "core")
    left = pieces.join(unlike, ["bucket", "core"]).groupBy("k1", "k2", "p").agg(F.collect_list(F.struct("lo", "hi")).alias("open"))
    left = cut.join(left, ["k1", "k2", "p"]).select("bucket", "n", "k1", "k2", "lo", "bytes", "open")
    strings = stored(map_texts(left, _strings(length), _STRING), "open-strings")
    again = strings.groupBy("bucket", "string").agg(F.sum("n").alias("n"), F.min("n").alias("least")).where("n > 1 and least = 1")
    single = strings.where("n = 1").join(again.select("bucket", "string"), ["bucket", "string"])
    single = single.select("k1", "k2", F.col("at").alias("lo"), (F.col("at") + length).alias("hi"))
    return known.unionByName(whole).unionByName(by_piece).unionByName(single)


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, q: int = Q, piece: int = PIECE, with_text: bool = True
) -> DataFrame:
    """A row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, repeated (n_removed > 0) and, with_text, kept: the
    remaining bytes."""
    texts = _keyed(docs)
    spans = repeated_spans(texts, length, q, piece)
    spans = spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    rows = texts.join(spans, ["k1", "k2"], "left").select("doc_id", "text", "spans")
    return map_texts(rows, _removal(with_text), _RESULT + ", kept binary" * with_text)
