"""Language-model scores from a hidden Markov model over words.

A word is emitted in two steps: the state emits the word's class, the class the word. Words with at least 1 / CLASS_SHARE of
the training tokens are classes of their own; all others fall into BUCKETS classes by a hash, inside which a word has its
smoothed share of the bucket's training counts, unseen words included. So the states' tables have a fixed size, whatever the
vocabulary, while word counts are exact over all training texts.

Training is Baum-Welch: each round every training text adds its expected transitions and emissions; they are summed by task,
then across partitions, and give the next tables. Training and scoring run over whole texts. Training keeps forward vectors at some
steps only and works the others out again on its way back, so memory does not follow a text's length; in scoring, very long
texts go through the scaled forward recursion in parts whose transfer matrices are then multiplied.

Words that are rarer than 1 / WORD_SHARE of the training tokens are not held in any worker: their counts come from a join.
All that is broadcast is bounded: at most WORD_SHARE words and the tables of at most CLASS_SHARE + BUCKETS + 1 classes.

Defined cases: a null text counts as empty and has one token, its end; a null doc_id is in no fold and trains; rows that repeat
are counted and scored each; without training texts every class is equally likely; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomsheet.llm.store import map_texts, stored

STATES = 8
ROUNDS = 5
WORD_SHARE = 1 << 19
CLASS_SHARE = 1 << 13
BUCKETS = 1 << 12
#: Tokens whose forward vectors training holds at once.
HELD = 1 << 18
#: Texts longer than this are scored in parts of this length.
PART = 1 << 15
FOLDS, HELD_OUT = 5, 1
#: Tokens, and texts, that a task gathers at most (but for one text) before it runs the recursion over them together.
TOGETHER = 1 << 22
TEXTS = 1 << 16
END = b"\n"
_SMOOTH = 0.5


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def words(raw: bytes) -> list[bytes]:
    """Words of a text's bytes: A-Z lower-cased, apart at spaces and bytes 9 to 13."""
    return raw.lower().split()


# counting -----------------------------------------------------------------------------------------------------------

_COUNT = pa.schema([("word", pa.binary()), ("c", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word counts by task, given out whenever there are many words, so that a task's memory is bounded."""

    def out(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], schema=_COUNT
        )

    counts: Counter = Counter()
    for batch in batches:
        for text in batch["text"].cast(pa.large_binary()):
            counts.update(words(text.as_buffer().to_pybytes()))
            if len(counts) > 500_000:
                yield out(counts)
                counts = Counter()
        counts[END] += batch.num_rows
    if counts:
        yield out(counts)


@dataclass(frozen=True)
class Vocabulary:
    """Counts of the frequent words and the sums of the hashed classes.

    Classes: 0 is the end of a text, then the words that are classes, then the buckets.
    """

    total: int
    distinct: int
    words: bytes
    counts: np.ndarray
    own: int
    bucket_tokens: np.ndarray
    bucket_words: np.ndarray

    @property
    def classes(self) -> int:
        return self.own + BUCKETS

    def index(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.words.split(b" "))} if self.words else {}

    def base_floor(self) -> float:
        return float(np.log10(self.total + _SMOOTH * (self.distinct + 1)))

    def bucket_floor(self) -> np.ndarray:
        return np.log10(self.bucket_tokens + _SMOOTH * (self.bucket_words + 1))


def count_words(train: DataFrame) -> tuple[DataFrame, Vocabulary]:
    """Exact counts (word, c) of all words of the training texts, and what of them is held by the workers."""
    counts = map_texts(train.select("text"), _count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))
    counts = stored(counts, "word-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    held = counts.where((F.col("c") * WORD_SHARE >= total) & (F.col("word") != F.lit(END)))
    held = held.toPandas().sort_values(["c", "word"], ascending=[False, True])
    own = int((held["c"] * CLASS_SHARE >= total).sum())
    ends = counts.where(F.col("word") == F.lit(END)).select("c").first()
    rest = counts.where((F.col("c") * CLASS_SHARE < total) & (F.col("word") != F.lit(END)))
    rest = rest.groupBy((F.crc32("word") % BUCKETS).alias("b")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n"))
    tokens, kinds = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for b, c, n in rest.collect():
        tokens[b], kinds[b] = c, n
    listed = [END, *map(bytes, held["word"])]
    number = np.array([ends["c"] if ends else 0, *held["c"]], np.int64)
    return counts, Vocabulary(total, distinct, b" ".join(listed), number, own + 1, tokens, kinds)


# encoding -----------------------------------------------------------------------------------------------------------

_CODED = pa.schema(
    [
        ("key", pa.int64()),
        ("doc_id", pa.int64()),
        ("held_out", pa.bool_()),
        ("n_tokens", pa.int64()),
        ("n_known", pa.int64()),
        ("logs", pa.float64()),
        ("inner", pa.float64()),
        ("classes", pa.binary()),
        ("rare", pa.list_(pa.binary())),
        ("times", pa.list_(pa.int32())),
    ]
)
_CODED_SQL = (
    "key long, doc_id long, held_out boolean, n_tokens long, n_known long, logs double, inner double, "
    "classes binary, rare array<binary>, times array<int>"
)


def _encode(shared):
    """Each text's class sequence, the sums over its frequent words, and its rare words to be joined with their counts."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = shared.value
        index = v.index()
        log_count = np.log10(v.counts + _SMOOTH)
        known = v.counts > 0
        floor = v.bucket_floor()
        names = v.words.split(b" ") if v.words else []
        klass = np.array(
            [i if i < v.own else v.own + zlib.crc32(w) % BUCKETS for i, w in enumerate(names)], np.int64
        )
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows = []
            for text in batch["text"].cast(pa.large_binary()):
                own = words(text.as_buffer().to_pybytes())
                own.append(END)
                ids = np.array([index.get(w, -1) for w in own], np.int64)
                at = np.flatnonzero(ids < 0)
                rare = Counter(own[i] for i in at)
                classes = klass[ids]
                if len(at):
                    classes[at] = [v.own + zlib.crc32(own[i]) % BUCKETS for i in at]
                held = ids[ids >= 0]
                inside = classes >= v.own
                share = log_count[ids[inside & (ids >= 0)]].sum() - floor[classes[inside] - v.own].sum()
                rows.append(
                    (
                        len(own),
                        int(known[held].sum()),
                        float(log_count[held].sum()),
                        float(share),
                        classes.astype(np.uint16).tobytes(),
                        list(rare),
                        list(rare.values()),
                    )
                )
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            fields = [_CODED.field(i) for i in range(3, 10)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(key, key + len(rows))),
                    batch["doc_id"],
                    batch["held_out"],
                    *(pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)),
                ],
                schema=_CODED,
            )
            key += len(rows)

    return made


# the model ----------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    """First-state, transition and emission probabilities; emission has a row for each class."""

    first: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def start(v: Vocabulary, states: int = STATES) -> Model:
    """States that keep to themselves and differ by a fixed noise about the class frequencies."""
    share = np.concatenate([v.counts[: v.own].astype(float), v.bucket_tokens]) + _SMOOTH
    share /= share.sum()
    noise = np.random.default_rng(5).normal(0, 1.0, (len(share), states))
    emit = share[:, None] * np.exp(noise)
    move = np.full((states, states), 0.05 / max(1, states - 1))
    np.fill_diagonal(move, 0.95 if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), move, emit / emit.sum(0))


class _Rows:
    """Sequences side by side, longest first: at each step those that have not ended are the first ones."""

    def __init__(self, sequences: list[np.ndarray]):
        self.length = np.array([len(s) for s in sequences], np.int64)
        self.order = np.argsort(-self.length, kind="stable")
        self.order = self.order[self.length[self.order] > 0]
        self.length = self.length[self.order]
        self.flat = np.concatenate([sequences[i] for i in self.order]) if len(self.order) else np.zeros(0, np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.steps = int(self.length[0]) if len(self.length) else 0

    def active(self, lo: int, hi: int) -> np.ndarray:
        """How many sequences have each of the steps from lo to before hi."""
        return np.searchsorted(-self.length, -np.arange(lo, hi), "left")

    def tokens(self, lo: int, hi: int, rows: int) -> np.ndarray:
        """(step, row), the last token again where a row has ended."""
        at = np.minimum(np.arange(lo, hi)[:, None], self.length[None, :rows] - 1)
        return self.flat[self.begin[None, :rows] + at].astype(np.int64)


def expected(model: Model, sequences: list[np.ndarray], held: int = HELD) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch counts of first states, transitions and emissions, and the log10 likelihood, over whole sequences.

    Steps are taken in spans of about ``held`` tokens. A first pass keeps the forward vectors at the spans' borders; a second
    one, from the last span to the first, works each span's forward vectors out again and carries the backward vectors on. So
    memory follows ``held`` and the number of sequences, however long they are.
    """
    rows, k = _Rows(sequences), len(model.first)
    moves, emitted = np.zeros((k, k)), np.zeros_like(model.emit)
    if not rows.steps:
        return np.zeros(k), moves, emitted, 0.0

    def forward(lo: int, hi: int, a: np.ndarray, keep: np.ndarray | None = None, scale: np.ndarray | None = None):
        seen = rows.tokens(lo, hi, len(a))
        for i, n in enumerate(rows.active(lo, hi)):
            b = (a[:n] @ model.move if lo + i else a[:n]) * model.emit[seen[i, :n]]
            c = b.sum(1)
            a = b / c[:, None]
            if keep is not None:
                keep[i, :n], scale[i, :n] = a, c
        return a, seen

    spans, lo, a = [], 0, np.repeat(model.first[None], len(rows.length), 0)
    while lo < rows.steps:
        n = int(rows.active(lo, lo + 1)[0])
        hi = min(rows.steps, lo + max(1, held // n))
        spans.append((lo, hi, a[:n]))
        if hi < rows.steps:
            a, _ = forward(lo, hi, a[:n])
        lo = hi
    backward = np.ones((len(rows.length), k))
    loglik, after = 0.0, None
    for lo, hi, a in reversed(spans):
        keep, scale = np.zeros((hi - lo, len(a), k)), np.ones((hi - lo, len(a)))
        _, seen = forward(lo, hi, a, keep, scale)
        active = rows.active(lo, hi + 1)
        for i in range(hi - lo - 1, -1, -1):
            n, later = active[i], active[i + 1]
            if later:
                token, c = (seen[i + 1, :later], scale[i + 1, :later]) if i + 1 < hi - lo else after
                right = model.emit[token] * backward[:later] / c[:, None]
                moves += keep[i, :later].T @ right * model.move
                backward[:later] = right @ model.move.T
            keep[i, :n] *= backward[:n]
        later = active[0]
        after = seen[0, :later], scale[0, :later]
        inside = np.arange(lo, hi)[:, None] < rows.length[None, : len(a)]
        token, weight = seen[inside], keep[inside]
        for j in range(k):
            emitted[:, j] += np.bincount(token, weight[:, j], len(emitted))
        loglik += float(np.log10(scale[inside]).sum())
    return keep[0].sum(0), moves, emitted, loglik


def likelihoods(model: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """The exact log10 probability of each sequence by the scaled forward recursion."""
    out = np.zeros(len(sequences))
    length = np.array([len(s) for s in sequences])
    k = len(model.first)
    short = np.flatnonzero(length <= PART)
    short = short[np.argsort(-length[short], kind="stable")]
    if len(short):
        # step by step over all sequences at once, those that have ended drop out at the back
        flat = np.concatenate([sequences[i] for i in short])
        first = np.cumsum(length[short]) - length[short]
        steps = length[short[0]]
        active = np.searchsorted(-length[short], -np.arange(steps), "left")
        a = np.repeat(model.first[None], len(short), 0)
        total = np.zeros(len(short))
        for t in range(steps):
            n = active[t]
            b = (a[:n] @ model.move if t else a[:n]) * model.emit[flat[first[:n] + t]]
            c = b.sum(1)
            total[:n] += np.log10(c)
            a[:n] = b / c[:, None]
        out[short] = total
    for i in np.flatnonzero(length > PART):
        out[i] = _long(model, sequences[i], k)
    return out


def _long(model: Model, s: np.ndarray, k: int) -> float:
    """One long sequence: parts side by side, each from every state, then their matrices one after another."""
    a = model.first * model.emit[s[0]]
    total = np.log10(a.sum())
    a /= a.sum()
    s = s[1:]
    whole = len(s) // PART
    parts = s[: whole * PART].reshape(whole, PART)
    m = np.repeat(np.eye(k)[None], whole, 0)
    logs = np.zeros(whole)
    for t in range(PART if whole else 0):
        m = (m @ model.move) * model.emit[parts[:, t]][:, None, :]
        c = m.sum((1, 2))
        logs += np.log10(c)
        m /= c[:, None, None]
    for i in range(whole):
        a = a @ m[i]
        total += logs[i] + np.log10(a.sum())
        a /= a.sum()
    for x in s[whole * PART :]:
        a = (a @ model.move) * model.emit[x]
        total += np.log10(a.sum())
        a /= a.sum()
    return float(total)


def _gathered(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[list[pa.RecordBatch], list[np.ndarray]]]:
    held: list[pa.RecordBatch] = []
    tokens: list[np.ndarray] = []
    size = 0
    for batch in batches:
        at = 0
        sequences = [np.frombuffer(c, np.uint16) for c in batch["classes"].to_pylist()]
        kept = batch.select(columns)
        for i, s in enumerate(sequences):
            tokens.append(s)
            size += len(s)
            if size >= TOGETHER or len(tokens) >= TEXTS:
                held.append(kept.slice(at, i + 1 - at))
                yield held, tokens
                held, tokens, size, at = [], [], 0, i + 1
        held.append(kept.slice(at))
    if tokens:
        yield held, tokens


_TALLY = "kind string, i int, counts array<double>"


def _tally(shared):
    """A task's summed counts: a row for the first states, for each state's transitions, and for each class."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        first, move, emit, loglik = 0.0, 0.0, 0.0, 0.0
        some = False
        for _, sequences in _gathered(batches, []):
            f, m, e, ll = expected(model, sequences)
            first, move, emit, loglik, some = first + f, move + m, emit + e, loglik + ll, True
        if not some:
            return
        seen = np.flatnonzero(emit.sum(1))
        kinds = ["first"] + ["move"] * len(move) + ["fit"] + ["emit"] * len(seen)
        numbers = [0, *range(len(move)), 0, *seen]
        fit = np.full(len(first), loglik)
        values = np.concatenate([first[None], move, fit[None], emit[seen]])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(kinds),
                pa.array(numbers, pa.int32()),
                pa.array(list(values), pa.list_(pa.float64())),
            ],
            names=["kind", "i", "counts"],
        )

    return made


def baum_welch(coded: DataFrame, v: Vocabulary, states: int = STATES, rounds: int = ROUNDS) -> tuple[Model, list[float]]:
    """The model after some rounds over all training texts, and the log10 likelihood before each round."""
    spark = coded.sparkSession
    texts = coded.where("not held_out").select("classes")
    model = start(v, states)
    fits = []
    share = np.concatenate([v.counts[: v.own].astype(float), v.bucket_tokens]) + _SMOOTH
    share /= share.sum()
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)
        sums = map_texts(texts, _tally(shared), _TALLY).groupBy("kind", "i")
        sums = sums.agg(*(F.sum(F.get("counts", F.lit(j))).alias(f"s{j}") for j in range(states)))
        # at most a row for each class and state: the tables' own size
        rows = sums.toPandas()
        if not len(rows):
            break
        value = rows[[f"s{j}" for j in range(states)]].to_numpy()
        kind, i = rows["kind"].to_numpy(), rows["i"].to_numpy()
        first = value[kind == "first"][0] + 0.1
        move, emit = np.zeros((states, states)), np.zeros_like(model.emit)
        move[i[kind == "move"]] = value[kind == "move"]
        emit[i[kind == "emit"]] = value[kind == "emit"]
        # a few pseudo-counts in proportion to the frequencies keep every class possible in every state
        emit += share[:, None] * (0.002 * emit.sum(0) + 1)
        move += 0.1
        fits.append(float(value[kind == "fit"][0][0]))
        model = Model(first / first.sum(), move / move.sum(1)[:, None], emit / emit.sum(0))
        shared.unpersist()
    return model, fits


def _forward(shared):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        keep = ["key", "doc_id", "held_out", "n_tokens", "n_known", "logs", "inner", "rare_tokens"]
        for held, sequences in _gathered(batches, keep):
            table = pa.Table.from_batches(held).combine_chunks().to_batches()
            hidden = likelihoods(model, sequences)
            at = 0
            for batch in table:
                part = pa.array(hidden[at : at + batch.num_rows])
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], part, batch.columns[-1]], names=[*keep[:-1], "hidden", keep[-1]])
                at += batch.num_rows

    return made


def score_texts(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """A row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities)."""
    spark = docs.sparkSession
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.coalesce("text", F.lit("")).alias("text")
    )
    counts, v = count_words(texts.where("not held_out"))
    coded = stored(map_texts(texts, _encode(spark.sparkContext.broadcast(v)), _CODED_SQL), "class-sequences")
    model, _ = baum_welch(coded, v, states, rounds)
    # rare words: their counts by a join, summed by text; what no training text holds counts 0
    asked = coded.select("key", F.explode(F.arrays_zip("rare", "times")).alias("r"))
    asked = asked.select("key", F.col("r.rare").alias("word"), F.col("r.times").alias("times"))
    found = asked.join(counts, "word").groupBy("key").agg(
        F.sum("times").alias("seen"), F.sum(F.col("times") * F.log10(F.col("c") + _SMOOTH)).alias("seen_logs")
    )
    spread = "key long, doc_id long, held_out boolean, n_tokens long, n_known long, logs double, inner double, hidden double"
    rare = F.aggregate("times", F.lit(0).cast("long"), lambda a, x: a + x)
    spread += ", rare_tokens long"
    columns = coded.select(*(f.split()[0] for f in spread.split(", ") if "hidden" not in f and "rare" not in f), "classes", rare.alias("rare_tokens"))
    scored = map_texts(columns, _forward(spark.sparkContext.broadcast(model)), spread)
    rows = scored.join(found, "key", "left")
    seen, seen_logs = F.coalesce("seen", F.lit(0)), F.coalesce("seen_logs", F.lit(0.0))
    unseen = (F.col("rare_tokens") - seen) * float(np.log10(_SMOOTH))
    joined = seen_logs + unseen
    return rows.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + seen).cast("long").alias("n_known"),
        F.lit(v.total).cast("long").alias("train_tokens"),
        (F.col("logs") + joined - F.col("n_tokens") * v.base_floor()).alias("base_score"),
        (F.col("hidden") + F.col("inner") + joined).alias("score"),
    )
