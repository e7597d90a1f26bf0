"""The hidden Markov model and the toxicity model: exactness, held-out quality, odd rows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomsheet.llm import hmm, toxicity

from .conftest import WORDS, frame, prose


def test_forward_recursion_is_exact(monkeypatch):
    rng = np.random.default_rng(0)
    m = hmm.Model(np.array([0.6, 0.4]), np.array([[0.7, 0.3], [0.2, 0.8]]), rng.dirichlet(np.ones(5), 2).T)
    sequences = [rng.integers(0, 5, n) for n in (1, 3, 16, 17, 40, 100, 33)]

    def plain(s):
        a = m.first * m.emit[s[0]]
        for x in s[1:]:
            a = (a @ m.move) * m.emit[x]
        return math.log10(a.sum())

    want = [plain(s) for s in sequences]
    assert np.allclose(hmm.likelihoods(m, sequences), want)
    monkeypatch.setattr(hmm, "PART", 16)
    assert np.allclose(hmm.likelihoods(m, sequences), want)
    first, move, emit, fit = hmm.expected(m, sequences)
    assert math.isclose(fit, sum(want))
    assert math.isclose(first.sum(), len(sequences)) and math.isclose(emit.sum(), sum(map(len, sequences)))
    assert math.isclose(move.sum(), sum(len(s) - 1 for s in sequences))


def test_expected_counts_equal_enumeration():
    from itertools import product

    m = hmm.Model(np.array([0.6, 0.4]), np.array([[0.7, 0.3], [0.2, 0.8]]), np.array([[0.5, 0.1], [0.5, 0.9]]))
    s = np.array([0, 1, 1, 0])
    total, emit, move = 0.0, np.zeros((2, 2)), np.zeros((2, 2))
    for path in product(range(2), repeat=len(s)):
        p = m.first[path[0]] * m.emit[s[0], path[0]]
        for t in range(1, len(s)):
            p *= m.move[path[t - 1], path[t]] * m.emit[s[t], path[t]]
        total += p
        for t, z in enumerate(path):
            emit[s[t], z] += p
            if t:
                move[path[t - 1], z] += p
    _, got_move, got_emit, _ = hmm.expected(m, [s])
    assert np.allclose(got_emit, emit / total) and np.allclose(got_move, move / total)


def test_counts_do_not_depend_on_the_spans():
    """Forward vectors kept at a few steps give the counts of those kept at all steps."""
    rng = np.random.default_rng(1)
    m = hmm.Model(np.array([0.6, 0.4]), np.array([[0.7, 0.3], [0.2, 0.8]]), rng.dirichlet(np.ones(5), 2).T)
    sequences = [rng.integers(0, 5, n) for n in (700, 1, 300, 299, 5, 40, 0, 1)]
    whole = hmm.expected(m, sequences, held=1 << 20)
    for held in (1, 7, 64, 1000):
        assert all(np.allclose(a, b) for a, b in zip(hmm.expected(m, sequences, held), whole, strict=True))


def plain_score(m, v, counts, tokens):
    """The log10 probability of a text, step by step, from the model's tables."""
    index, logp, a = v.index(), 0.0, None
    for w in tokens:
        i = index.get(w, v.own)
        if i >= v.own:
            b = zlib.crc32(w) % hmm.BUCKETS
            i = v.own + b
            logp += math.log10((counts[w] + 0.5) / (v.bucket_tokens[b] + 0.5 * (v.bucket_words[b] + 1)))
        a = (m.first if a is None else a @ m.move) * m.emit[i]
        logp += math.log10(a.sum())
        a = a / a.sum()
    return logp


def test_scores(spark, odd_docs, no_docs, monkeypatch):
    made, train_model = [], hmm.baum_welch

    def kept(coded, v, *options):
        made.append((v, train_model(coded, v, *options)))
        return made[-1][1]

    monkeypatch.setattr(hmm, "baum_welch", kept)
    monkeypatch.setattr(hmm, "CLASS_SHARE", 64)
    monkeypatch.setattr(hmm, "WORD_SHARE", 256)
    docs = odd_docs.unionByName(frame(spark, [(100 + i, prose(i % 7, 60), "s") for i in range(60)]))
    got = hmm.score_texts(docs, states=3, rounds=2).collect()
    rows = docs.collect()
    tokens = [[*(r.text or "").encode().lower().split(), b"\n"] for r in rows]
    train = [t for r, t in zip(rows, tokens, strict=True) if r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 != 1]
    c = Counter(w for t in train for w in t)
    total, v = sum(c.values()), len(c)
    want = Counter()
    for r, t in zip(rows, tokens, strict=True):
        base = sum(math.log10((c[w] + 0.5) / (total + 0.5 * (v + 1))) for w in t)
        held = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 1
        want[(r.doc_id, held, len(t), sum(c[w] > 0 for w in t), total, round(base, 4))] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    v, (m, _) = made[-1]
    scores = Counter((r.doc_id, round(plain_score(m, v, c, t), 4)) for r, t in zip(rows, tokens, strict=True))
    assert Counter((r.doc_id, round(r.score, 4)) for r in got) == scores
    assert hmm.score_texts(no_docs, states=2, rounds=1).count() == 0


def test_class_emissions_sum_to_one(spark, monkeypatch):
    """Every word's share of its class, with one unseen word for each class, makes a distribution."""
    monkeypatch.setattr(hmm, "CLASS_SHARE", 8)
    docs = frame(spark, [(i, prose(i, 50), "s") for i in range(40)]).select("text")
    counts, v = hmm.count_words(docs)
    tokens, kinds = v.bucket_tokens, v.bucket_words
    inside = sum(
        (r["c"] + 0.5) / (tokens[b] + 0.5 * (kinds[b] + 1))
        for r in counts.where(f"c * {hmm.CLASS_SHARE} < {v.total}").collect()
        if bytes(r["word"]) != hmm.END and (b := zlib.crc32(bytes(r["word"])) % hmm.BUCKETS) == 7
    )
    if kinds[7]:
        assert math.isclose(inside + 0.5 / (tokens[7] + 0.5 * (kinds[7] + 1)), 1.0)


def test_training_raises_the_likelihood(spark):
    docs = frame(spark, [(i, prose(i % 2, 80) if i % 2 else " ".join(f"z{j}" for j in range(80)), "s") for i in range(60)])
    texts = docs.select("doc_id", F.lit(False).alias("held_out"), "text")
    _, v = hmm.count_words(texts)
    coded = texts.mapInArrow(hmm._encode(spark.sparkContext.broadcast(v)), hmm._CODED_SQL)
    _, fits = hmm.baum_welch(coded, v, states=2, rounds=5)
    assert fits[-1] > fits[0]


SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def toxic_model(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity.train(docs, labels)


def test_toxicity_on_held_out_texts(spark, toxic_model):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.score_texts(docs, toxic_model).join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    # in this table only English texts hold what the label marks; in the other languages it is noise
    bad = [r for r in rows if r.toxic == 1 and r.lang == "en"]
    assert sum(r.predicted for r in bad) >= 0.8 * len(bad)
    assert sum(r.predicted for r in rows if r.toxic == 0) <= 0.005 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def plain_windows(text: bytes) -> Counter:
    found = Counter()

    def pieces(w):
        at = 0
        while True:
            found[w[at : at + toxicity.LONGEST]] += 1
            if at + toxicity.LONGEST >= len(w):
                return
            at += toxicity.LONGEST // 2

    for sentence in re.split(rb"(?<=[.!?])[\x09-\x0D ]|\n", text):
        words = bytes(b for b in sentence.lower() if not toxicity._PUNCTUATION[b]).split()
        for w in words:
            pieces(w)
        for a, b in zip(words, words[1:]):
            found[a[-toxicity.HALF :] + b" " + b[: toxicity.HALF]] += 1
        run = b""
        for w in [*words, b"xx"]:
            if len(w) == 1:
                run += w
            else:
                if len(run) >= 3:
                    pieces(run)
                run = b""
    return found


def plain_margin(m, w: bytes) -> float:
    code, total, square = [int(toxicity._CODES[b]) for b in w], 0.0, 0.0
    for i in range(len(w)):
        for k in range(i + 2, min(len(w), i + toxicity.SPAN)):
            for j in range(i + 1, k):
                part = toxicity.DECAY ** (k - i + 1)
                total += part * m.weights[code[i] << 12 | code[j] << 6 | code[k]]
                square += part * part
    return max(m.least, total / max(square**0.5, toxicity.DECAY**3) + m.offset)


def test_margins_equal_plain_sums(toxic_model):
    """A text's margin against an enumeration of its windows and of their subsequences."""
    rng = random.Random(4)
    letters = ["a", "b", "Q", "9", " ", "  ", "\t", "\n", ".", "! ", "-", "é", "moron", " idiot ", "x" * 30, " m o r o n ", "\x01"]
    texts = ["", " ", "a", "...", *("".join(rng.choices(letters, k=rng.randrange(1, 60))) for _ in range(60))]
    got = toxic_model.texts(pa.array(texts))
    for t, g in zip(texts, got, strict=True):
        raw = np.frombuffer(t.encode(), np.uint8)
        seen = Counter(toxicity.windows(raw, np.array([0, len(raw)])).strings())
        assert seen == plain_windows(t.encode()), t
        assert math.isclose(g, max((plain_margin(toxic_model, w) for w in seen), default=toxic_model.least), abs_tol=1e-7)


def test_an_insult_of_two_plain_words_is_learned(spark):
    """Each word stands in clean sentences too; only their pair marks toxic ones."""
    rng = random.Random(7)
    say = lambda *w: " ".join([*rng.choices(WORDS, k=4), *w, *rng.choices(WORDS, k=4)]) + "."
    rows = [(i, say("wet", "sock") if i % 4 == 0 else say("wet") + " " + say("sock")) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    got = toxicity.score_texts(docs, toxicity.train(docs, labels)).collect()
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == int(r.doc_id % 4 == 0) for r in held) >= 0.95 * len(held)


def test_gaps_and_insertions_are_tolerated(toxic_model):
    worst = lambda t: float(toxic_model.texts(pa.array([t]))[0])
    for word in ("moron", "idiot", "stupid"):
        for form in (word, ".".join(word), " ".join(word), word[:2] + "-" + word[2:], word[:2] + "x" + word[2:], word[:2] + " " + word[2:]):
            assert worst(f"you {form} there") > worst("the morning is fine there")


def test_toxicity_of_odd_rows(spark, odd_docs, no_docs, toxic_model):
    got = toxicity.score_texts(odd_docs, toxic_model).collect()
    assert len(got) == odd_docs.count()
    assert all(r.predicted == int(r.score >= 0.7) for r in got)
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 1), (4, 0), (77, 1)], "doc_id long, toxic int")
    assert toxicity.drop_toxic(odd_docs, labels).columns == odd_docs.columns
    assert toxicity.drop_toxic(odd_docs, labels.limit(0)).count() == odd_docs.count()
    assert toxicity.drop_toxic(no_docs, labels).count() == 0
    assert toxicity.score_texts(no_docs, toxic_model).count() == 0


def test_kernel_is_a_kernel():
    words = [b"moron", b"mo-ron", b"moxron", b"more", b"zzz"]
    k = toxicity.kernel(words, words)
    assert np.allclose(k, k.T) and np.linalg.eigvalsh(k).min() > -1e-9
    assert k[0, 2] > k[0, 3] > k[0, 4]
