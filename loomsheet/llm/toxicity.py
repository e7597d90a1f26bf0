"""Toxicity by a support vector machine over a gap-weighted subsequence string kernel, with Nystrom landmarks.

The kernel of two strings counts their common subsequences of three characters inside SPAN characters, each weighted by
DECAY to the length it spans, and divides by the norms of their lengths. Gaps are part of the kernel, so an insult with
characters put in ("mo-xron", "mo ron") still shares most of its subsequences with the plain one.

A sentence is seen through windows, after lower-casing and without punctuation: its words (long ones in overlapping pieces), its
pairs of neighbouring words with the space between them (the HALF characters on both sides of it), and runs of three and more
single characters ("m o r o n") put together. A sentence scores as its worst window, a text as its worst sentence.

The machine is trained on labelled sentences, those of a bounded sample of labelled texts (``most_toxic`` and ``most_clean``, by
a hash of doc_id; a sentence of several texts counts once, and as clean if one of them is). As not every sentence of a toxic
text is toxic, training alternates, as multiple-instance machines do, between choosing the window that stands for each toxic
sentence and fitting. At first that is a window which stands in toxic sentences far more often than chance; then it is the one
with the largest margin. Clean sentences bring random and frequent windows, then those with the largest margins. The solver
holds at most ``most_examples`` windows of each kind, weighted by their sentences. Where the sample takes unlike shares of the
two labels, clean sentences are weighted by the inverse.

Landmarks of both kinds give the Nystrom map, a squared-hinge SVM is fitted on it, and a logistic curve turns a text's margin
into a score. The kernel against all landmarks folds into one weight per subsequence, so the margins of all windows of a text
are differences of prefix sums over its characters: memory follows the text's length, time is a few table lookups a character.

Inputs of a score are texts alone. Defined cases: a null text counts as empty; a text without words gets the least score that
the model gives to the lack of evidence; without any toxic training text every score is 0; labels that repeat a doc_id count
as toxic if one of them is; null labels are left out; rows that repeat score alike; empty tables give an empty result; further
columns are ignored, or passed through by :func:`drop_toxic`.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomsheet.llm import text as T
from loomsheet.llm.store import map_texts, stored

SPAN = 5
DECAY = 0.7
LANDMARKS = 384
MOST_TOXIC = 5_000
MOST_CLEAN = 10_000
MOST_EXAMPLES = 6_000
THRESHOLD = 0.7
FOLDS, HELD_OUT = 3, 1
#: Rounds of choosing windows by their margins and fitting again.
ROUNDS = 2
#: Words longer than this are seen in pieces that overlap by half; a pair shows at most HALF characters of each word.
LONGEST = 24
HALF = 12

_CODES = np.full(256, 63, np.int64)
_CODES[97:123] = _CODES[65:91] = np.arange(1, 27)
_CODES[48:58] = np.arange(27, 37)
_CODES[128:] = 37 + np.arange(128) % 26
_SPACE = np.zeros(256, bool)
_SPACE[9:14] = _SPACE[32] = True
_CODES[_SPACE] = 0
_ONE_SPACE = bytes(32 if _SPACE[i] else i for i in range(256))
_PUNCTUATION = np.array([33 <= i < 127 and not chr(i).isalnum() for i in range(256)])
_ENDS = np.array([chr(i) in ".!?" for i in range(256)])
_TABLE = 1 << 18
_PLACES = [(a, b) for b in range(2, SPAN) for a in range(1, b)]


@dataclass(frozen=True)
class Windows:
    """Windows [start, end) into a string of kept bytes, and the row that each belongs to."""

    kept: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray

    def strings(self) -> list[bytes]:
        raw = self.kept.tobytes().lower().translate(_ONE_SPACE)
        return [raw[i:j] for i, j in zip(self.start.tolist(), self.end.tolist(), strict=True)]


def _pieces(start: np.ndarray, end: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of at most LONGEST characters that overlap by half."""
    step = LONGEST // 2
    n = np.maximum(1, -(-(end - start) // step) - 1)
    each = np.repeat(np.arange(len(n)), n)
    at = start[each] + step * (np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n))
    return at, np.minimum(end[each], at + LONGEST), row[each]


def windows(data: np.ndarray, offsets: np.ndarray) -> Windows:
    """The windows of the sentences of rows of bytes."""
    space = _SPACE[data]
    after = np.zeros(len(data), bool)
    after[1:] = _ENDS[data[:-1]]
    breaks = np.cumsum(space & (after | (data == 10)))
    keep = ~_PUNCTUATION[data]
    # of spaces that follow each other one is kept
    at = np.flatnonzero(keep)
    again = np.zeros(len(at), bool)
    again[1:] = space[at[1:]] & space[at[:-1]]
    at = at[~again]
    kept, breaks = data[at], breaks[at]
    bounds = np.searchsorted(at, offsets)
    start, end, first = T.word_bounds(kept, bounds, ~_SPACE)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    near = np.flatnonzero((row[1:] == row[:-1]) & (breaks[start[1:]] == breaks[start[:-1]]))
    parts = [_pieces(start, end, row)]
    parts.append((np.maximum(start[near], end[near] - HALF), np.minimum(end[near + 1], start[near + 1] + HALF), row[near]))
    # runs of single characters, written out again behind the others
    single = end - start == 1
    joined = np.zeros(len(start) + 1, bool)
    joined[near + 1] = single[near] & single[near + 1]
    lone = np.flatnonzero(single)
    fresh = ~joined[lone]
    size = np.bincount(np.cumsum(fresh) - 1, minlength=int(fresh.sum())) if len(lone) else np.zeros(0, np.int64)
    long = size >= 3
    if long.any():
        own = lone[np.repeat(long, size)]
        ends = np.cumsum(size[long]) + len(kept)
        parts.append(_pieces(ends - size[long], ends, row[lone[fresh]][long]))
        kept = np.concatenate([kept, kept[start[own]]])
    return Windows(kept, *(np.concatenate(x) for x in zip(*parts, strict=True)))


def _norms() -> np.ndarray:
    """The norm of a window of each length: all its subsequences counted once."""
    n = np.arange(max(LONGEST, 2 * HALF + 1) + 1)
    square = sum(np.maximum(0, n - b) * DECAY ** (2 * (b + 1)) for _, b in _PLACES)
    return np.sqrt(np.maximum(square, DECAY**6))


_NORMS = _norms()


def subsequences(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word, subsequence, weight) of all words, and the words' lengths."""
    lengths = np.array([len(w) for w in words], np.int64)
    codes = _CODES[np.frombuffer(b"".join(words), np.uint8)]
    word = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))
    rows, names, weights = [], [], []
    for a, b in _PLACES:
        at = np.flatnonzero(left > b)
        rows.append(word[at])
        names.append((codes[at] << 12) | (codes[at + a] << 6) | codes[at + b])
        weights.append(np.full(len(at), DECAY ** (b + 1)))
    return np.concatenate(rows), np.concatenate(names), np.concatenate(weights), lengths


def kernel(words: list[bytes], landmarks: list[bytes]) -> np.ndarray:
    """The normalised kernel of each word with each landmark."""
    row, name, weight, lengths = subsequences(landmarks)
    known, column = np.unique(name, return_inverse=True)
    table = lambda r, c, w, n: np.bincount(r * len(known) + c, w, n * len(known)).reshape(n, -1)
    basis = table(row, column, weight, len(landmarks))
    basis /= _NORMS[lengths][:, None]
    out = np.zeros((len(words), len(landmarks)))
    for i in range(0, len(words), 256):
        row, name, weight, lengths = subsequences(words[i : i + 256])
        column = np.minimum(np.searchsorted(known, name), len(known) - 1)
        hit = known[column] == name
        dense = table(row[hit], column[hit], weight[hit], len(lengths))
        out[i : i + len(lengths)] = (dense / _NORMS[lengths][:, None]) @ basis.T
    return out


@dataclass(frozen=True)
class Model:
    """A weight for each subsequence, the margin's offset, and the logistic curve over a text's margin."""

    weights: np.ndarray
    offset: float
    slope: float = 0.0
    level: float = -50.0

    #: The margin of a text without words.
    least = -3.0

    def margins(self, seen: Windows) -> np.ndarray:
        codes = _CODES[seen.kept]
        total = np.zeros(len(seen.start))
        for b in range(2, SPAN):
            n = max(0, len(codes) - b)
            sums = np.zeros(len(codes) + 1)
            outer = (codes[:n] << 12) | codes[b : b + n]
            value = sum(self.weights[outer | (codes[a : a + n] << 6)] for a in range(1, b))
            np.cumsum(value, out=sums[1 : n + 1])
            sums[n + 1 :] = sums[n]
            total += DECAY ** (b + 1) * (sums[np.maximum(seen.start, seen.end - b)] - sums[seen.start])
        # rounded, so that a text's margin does not depend on the texts before it
        return np.maximum(self.least, np.round(total / _NORMS[seen.end - seen.start] + self.offset, 9))

    def texts(self, column: pa.Array) -> np.ndarray:
        """The largest margin of each text."""
        out = np.full(len(column), self.least)
        for first, _, data, offsets in T.slices(column):
            seen = windows(data, offsets)
            np.maximum.at(out, seen.row + first, self.margins(seen))
        return out

    def score(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.level, -50, 50)))


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Squared-hinge weights by Newton steps over the examples inside the margin; the last column of x is constant."""
    w = np.zeros(x.shape[1])
    for _ in range(60):
        inside = y * (x @ w) < 1
        a, c = x[inside], cost[inside]
        grad = ridge * w - (a * c[:, None]).T @ (y[inside] - a @ w)
        step = np.linalg.solve(ridge * np.eye(len(w)) + (a * c[:, None]).T @ a, grad)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def inserted(unit: bytes) -> list[bytes]:
    """The string with one more character at each inner place, so that the margin allows for insertions."""
    return [unit[:i] + b"xqz"[i % 3 : i % 3 + 1] + unit[i:] for i in range(1, len(unit))] if 4 <= len(unit) < LONGEST else []


def fit_windows(bad: dict[bytes, float], good: dict[bytes, float], landmarks: int = LANDMARKS) -> Model:
    """The SVM from the windows of toxic and of clean sentences, each with its weight."""
    # the most frequent toxic windows also in changed forms, at a smaller cost
    order = sorted(bad, key=lambda u: (-bad[u], u))
    often = order[: landmarks // 8]
    changed = [(v, bad[u]) for u in often for v in inserted(u)]
    chosen = [*often, *order[:: max(1, 4 * len(order) // landmarks)], *(v for v, _ in changed[:: max(1, 4 * len(changed) // landmarks)])]
    chosen = list(dict.fromkeys([*chosen, *list(good)[: max(0, landmarks - len(chosen))]]))
    middle = kernel(chosen, chosen)
    value, vector = np.linalg.eigh(middle)
    keep = value > 1e-5 * value[-1]
    nystrom = vector[:, keep] / np.sqrt(value[keep])
    strings = [*bad, *(u for u, _ in changed), *good]
    x = kernel(strings, chosen) @ nystrom
    x = np.hstack([x, np.ones((len(x), 1))])
    positive = len(strings) - len(good)
    y = np.where(np.arange(len(strings)) < positive, 1.0, -1.0)
    weight = np.array([*(max(1.0, n / 5) for n in bad.values()), *(0.2 * max(1.0, n / 5) for _, n in changed), *good.values()])
    w = _svm(x, y, 20.0 * weight)
    beta = nystrom @ w[:-1]
    row, name, part, lengths = subsequences(chosen)
    table = np.bincount(name, part * (beta / _NORMS[lengths])[row], _TABLE)
    return Model(table, float(w[-1]))


def _curve(margin: np.ndarray, label: np.ndarray, clean_weight: float) -> tuple[float, float]:
    """Slope and level of a logistic curve, with soft targets so that separable labels give a finite slope."""
    good, bad = (label == 0).sum() * clean_weight, (label == 1).sum()
    target = np.where(label == 1, (bad + 1) / (bad + 2), 1 / (good + 2))
    weight = np.where(label == 1, 1.0, clean_weight)
    x = np.stack([margin, np.ones(len(margin))], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (weight * (p - target)))
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(w[1])


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT


_SENTENCE = pa.schema([("id", pa.int64()), ("text", pa.binary()), ("toxic", pa.int32())])


def _sentences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sentences of labelled texts: they end where a space follows . ! or ? and at line ends."""
    import xxhash

    for batch in batches:
        toxic = batch["toxic"].to_numpy()
        for first, end, data, offsets in T.slices(batch["text"]):
            after = np.zeros(len(data), bool)
            after[1:] = _ENDS[data[:-1]]
            cuts = np.flatnonzero(_SPACE[data] & (after | (data == 10))) + 1
            cuts = np.unique(np.concatenate([cuts, offsets]))
            raw = data.tobytes()
            parts = [raw[i:j] for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            row = np.searchsorted(offsets, cuts[:-1], "right") - 1 + first
            ids = [xxhash.xxh64_intdigest(p.strip().lower()) - (1 << 63) for p in parts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(parts, pa.binary()), pa.array(toxic[row])], schema=_SENTENCE)


def _bags(batch: pa.RecordBatch) -> Iterator[tuple[Windows, np.ndarray]]:
    """The windows of a batch of sentences, some at a time, and whether each stands in a toxic one."""
    toxic = batch["toxic"].to_numpy()
    for first, _, data, offsets in T.slices(batch["text"]):
        seen = windows(data, offsets)
        yield seen, toxic[seen.row + first] == 1


_COUNTED = pa.schema([("window", pa.binary()), ("bad", pa.int64()), ("good", pa.int64())])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many toxic and clean sentences each window stands, by task, given out whenever there are many."""

    def out(n: dict[bytes, list[int]]) -> pa.RecordBatch:
        columns = [list(n), [v[1] for v in n.values()], [v[0] for v in n.values()]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _COUNTED, strict=True)], schema=_COUNTED)

    n: dict[bytes, list[int]] = defaultdict(lambda: [0, 0])
    for batch in batches:
        for seen, toxic in _bags(batch):
            last, done = -1, set()
            for w, r, t in zip(seen.strings(), seen.row.tolist(), toxic.tolist(), strict=True):
                # windows come kind by kind, each in order of rows
                if r < last:
                    done = set()
                last = r
                if (r, w) not in done:
                    done.add((r, w))
                    n[w][t] += 1
            if len(n) > 400_000:
                yield out(n)
                n.clear()
    if n:
        yield out(n)


def _witnesses(model, least: float):
    """For each sentence its window with the largest margin, if that exceeds least: (window, toxic, margin)."""
    schema = pa.schema([("window", pa.binary()), ("toxic", pa.int32()), ("margin", pa.float64())])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seen, toxic in _bags(batch):
                margin = model.value.margins(seen)
                order = np.lexsort((margin, seen.row))
                best = order[np.append(seen.row[order][1:] != seen.row[order][:-1], True)] if len(order) else order
                best = best[margin[best] > least]
                found = Windows(seen.kept, seen.start[best], seen.end[best], seen.row[best])
                columns = [pa.array(found.strings(), pa.binary()), pa.array(toxic[best].astype(np.int32)), pa.array(margin[best])]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return made


def _text_margins(model):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [n for n in batch.schema.names if n != "text"]
            columns = [batch[n] for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(model.value.texts(batch["text"]))], names=[*names, "margin"])

    return made


def _sample(docs: DataFrame, labels: DataFrame, most_toxic: int, most_clean: int) -> tuple[DataFrame, float]:
    """(text, toxic) of the training texts with the least hashes of each label, and what a clean one weighs."""
    rows = labels.where(~held_out() & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    rows = rows.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    rows = stored(rows.where("toxic in (0, 1)"), "toxicity-labels")
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    order = F.xxhash64(F.lit(3), "doc_id")
    toxic = rows.where("toxic = 1").orderBy(order).limit(most_toxic)
    ids = toxic.unionByName(rows.where("toxic = 0").orderBy(order).limit(most_clean))
    weight = max(1.0, n.get(0, 0) / most_clean) / max(1.0, n.get(1, 0) / most_toxic)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return stored(texts.join(F.broadcast(ids), "doc_id").select("text", "toxic"), "toxicity-sample"), weight


def train(
    docs: DataFrame,
    labels: DataFrame,
    most_toxic: int = MOST_TOXIC,
    most_clean: int = MOST_CLEAN,
    most_examples: int = MOST_EXAMPLES,
    landmarks: int = LANDMARKS,
) -> Model:
    """The model from the labelled texts that are not held out; docs has doc_id and text, labels doc_id and toxic."""
    spark = docs.sparkSession
    sample, clean_weight = _sample(docs, labels, most_toxic, most_clean)
    rows = map_texts(sample, _sentences, "id long, text binary, toxic int").groupBy("id")
    sentences = stored(rows.agg(F.any_value("text").alias("text"), F.min("toxic").alias("toxic")), "labelled-sentences")
    counts = map_texts(sentences, _counts, "window binary, bad long, good long").groupBy("window")
    counts = counts.agg(F.sum("bad").cast("double").alias("bad"), (F.sum("good") * clean_weight).alias("good"))
    counts = stored(counts.withColumn("n", F.col("bad") + F.col("good")), "toxicity-windows")
    total = counts.agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("windows")).first()
    nothing = Model(np.zeros(_TABLE), -3.0)
    if not total["bad"] or total["bad"] == total["n"]:
        return nothing
    share = F.lit(total["bad"] / total["n"])
    part = F.col("bad") / F.col("n")
    # how unlikely so many toxic sentences are by chance (Chernoff), against the number of windows looked at
    excess = part * F.ln(part / share) + F.when(part < 1, (1 - part) * F.ln((1 - part) / (1 - share))).otherwise(0.0)
    sure = F.col("n") * excess
    bad = counts.where((F.col("bad") >= 3) & (part > 0.5) & (part > 2 * share) & (sure > float(np.log(10 * total["windows"]))))
    bad = bad.orderBy(F.desc(sure), "window").limit(most_examples).select("window", "bad").collect()
    clean = counts.where("bad = 0 or bad < 0.1 * n").where(F.octet_length("window") >= 3)
    often = clean.orderBy(F.desc("n"), "window").limit(most_examples // 3).select("window").collect()
    other = clean.orderBy(F.xxhash64("window")).limit(most_examples).select("window").collect()
    bad = {bytes(r["window"]): float(r["bad"]) for r in bad}
    good = {bytes(r["window"]): 1.0 for r in [*other, *often] if bytes(r["window"]) not in bad}
    if not bad or not good:
        return nothing
    model = fit_windows(bad, good, landmarks)
    for _ in range(ROUNDS):
        # each sentence's window of the largest margin: it stands for a toxic sentence, and against the machine for a clean one
        found = map_texts(sentences, _witnesses(spark.sparkContext.broadcast(model), -1.0), "window binary, toxic int, margin double")
        found = found.groupBy("window").agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("n"), F.max("margin").alias("margin"))
        found = stored(found, "toxicity-witnesses")
        mine = found.where("bad > 0 and margin > 0 and bad > 0.5 * n").orderBy(F.desc("bad"), "window").limit(most_examples).collect()
        hard = found.where("bad < 0.1 * n").orderBy(F.desc("margin"), "window").limit(most_examples).select("window").collect()
        bad |= {w: float(r["bad"]) for r in mine if (w := bytes(r["window"])) in bad or r["bad"] >= 3}
        good |= {w: 1.0 for r in hard if (w := bytes(r["window"])) not in bad}
        good = {w: n for w, n in good.items() if w not in bad}
        model = fit_windows(bad, good, landmarks)
    margins = map_texts(sample, _text_margins(spark.sparkContext.broadcast(model)), "toxic int, margin double").toPandas()
    slope, level = _curve(margins["margin"].to_numpy(), margins["toxic"].to_numpy(), clean_weight)
    return Model(model.weights, model.offset, slope, level)


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """A row per document: doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = map_texts(rows, _text_margins(shared), "doc_id long, margin double")
    score = 1 / (1 + F.exp(-(F.col("margin") * model.slope + model.level)))
    return rows.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """docs without the texts that are predicted toxic, all columns kept, in one pass over the texts."""
    model = train(docs, labels, **options)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.score(shared.value.texts(batch["text"])) < THRESHOLD))

    return map_texts(docs, kept, docs.schema)
