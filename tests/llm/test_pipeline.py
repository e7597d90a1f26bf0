"""The pipeline against a plain version of its stages, each judged on its own input."""

import random
import string
import zlib
from collections import Counter

import pytest

import corpus_pipeline
from loomsheet.llm import mixing, toxicity
from loomsheet.llm.store import stored

from .conftest import frame, prose
from .test_exact_and_mixing import targets
from .test_text_searches import contamination, links_by_force

SF = "/root/testdata/sf0.001"
INSULTS = ("moron", "idiot", "pathetic", "worthless")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), f"test-{name}")
        found.append(docs)
    return found


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns(steps):
    assert all(s.columns == steps[0].columns for s in steps[:-1])
    assert steps[-1].columns[: len(steps[0].columns)] == steps[0].columns


def test_toxic_texts_go(spark, steps):
    """Of texts with known insults, plain and with characters put in, those outside the training fold go; all others stay."""
    kept = set(ids(steps[1]))
    assert kept <= set(ids(steps[0]))
    rng = random.Random(3)
    plain = lambda i: f"{prose(i, 12)}. {prose(i + 5000, 9)}."
    hidden = lambda w: w if rng.random() < 0.7 else w[:3] + rng.choice("-x. ") + w[3:]
    toxic = {i: i % 4 == 0 for i in range(800)}
    rows = [(i, plain(i) + (f" You {hidden(rng.choice(INSULTS))} {prose(i, 2)}." if bad else ""), "s") for i, bad in toxic.items()]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, int(bad)) for i, bad in toxic.items()], "doc_id long, toxic int")
    left = ids(toxicity.drop_toxic(docs, labels))
    clean = [i for i, bad in toxic.items() if not bad]
    held = [i for i, bad in toxic.items() if bad and zlib.crc32(str(i).encode()) % 3 == 1]
    assert set(clean) <= set(left)
    assert len(held) > 30 and len(set(held) & set(left)) <= 0.1 * len(held)


def test_copies_go(steps):
    last = {}
    for r in steps[1].collect():
        key = (r.text or "").translate(LOWER)
        last[key] = max(last.get(key, r.doc_id), r.doc_id)
    assert ids(steps[2]) == sorted(last.values())


def test_near_copies_go(steps):
    rows = sorted(steps[2].collect(), key=lambda r: r.doc_id)
    _, group = links_by_force([r.text for r in rows])
    assert ids(steps[3]) == sorted({rows[g].doc_id for g in group})


def test_benchmark_texts_go(spark, steps):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in steps[3].collect()]
    clean = sorted(k[0] for k in contamination(rows, items, 10) if not k[-1])
    assert ids(steps[4]) == clean


def test_mix_meets_the_targets(steps):
    size = lambda t: len((t or "").encode().split())
    sizes, taken = Counter(), Counter()
    longest = 0
    for r in steps[4].collect():
        sizes[r.source] += size(r.text)
        longest = max(longest, size(r.text))
    copies = Counter()
    for r in steps[5].collect():
        taken[r.source] += size(r.text)
        copies[r.doc_id] += 1
    assert all(abs(taken[s] - t) <= longest for s, t in targets(sizes).items())
    assert max(copies.values()) <= mixing.MOST_PASSES
