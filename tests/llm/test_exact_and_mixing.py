"""Exact dedup, mixing and URL filters on odd rows and against plain computations."""

import hashlib
import string
from collections import Counter, defaultdict
from math import exp, lgamma

import pytest
from pyspark.sql import functions as F

from loomsheet.llm import exact_dedup, mixing, url_filter

from .conftest import frame, prose

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def test_exact_dedup(spark, odd_docs, no_docs):
    rows = odd_docs.collect()
    groups = defaultdict(list)
    for r in rows:
        groups[(r.text or "").translate(LOWER)].append(r.doc_id)
    want = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        digest = hashlib.sha256(text.encode()).hexdigest()
        want += [(i, keep, len(ids), i == keep, digest) for i in ids]
    got = [tuple(r) for r in exact_dedup.exact_dedup(odd_docs).collect()]
    assert Counter(got) == Counter(want)
    assert exact_dedup.exact_dedup(no_docs).count() == 0
    kept = exact_dedup.drop_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter({w[0] for w in want if w[3] and w[0] is not None} | set()) + Counter(
        {None: sum(1 for text, ids in groups.items() if all(i is None for i in ids))}
    )


def test_frequent_digests_take_the_map_side(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "Hot").otherwise(F.col("id").cast("string")).alias("text"))
    got = exact_dedup.exact_dedup(docs)
    hot = got.where("group_size = 1000").agg(F.min("keep_id"), F.max("keep_id"), F.sum(F.col("kept").cast("int"))).first()
    assert tuple(hot) == (2997, 2997, 1)
    assert got.where("group_size = 1 and kept").count() == 2000
    assert exact_dedup.drop_copies(docs).count() == 2001


def targets(sizes, weights=(1, 2, 3)):
    """By rounds: shares by weight, the excess over three times a size shared again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[t] for t in rest) for s in rest}
        over = [s for s in rest if share[s] > 3 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3.0 * sizes[s] for s in over}


def test_mix(spark, odd_docs, no_docs):
    many = frame(spark, [(100 + i, prose(i, 5 + i % 40), "abcd"[i % 4] if i % 9 else "rare") for i in range(400)])
    for docs in (odd_docs, many, odd_docs.unionByName(many)):
        rows = docs.collect()
        sizes = Counter()
        for r in rows:
            sizes[r.source] += len((r.text or "").encode().split())
        got = mixing.mix_report(docs, block_words=500).collect()
        assert len(got) == len(rows)
        want = targets(sizes)
        assert sorted((r.source_size, round(r.target, 6)) for r in got) == sorted((sizes[r.source], round(want[r.source], 6)) for r in rows)
        assert all(0 <= r.taken <= 3 * r.size for r in got)
        again = mixing.mix_report(docs.repartition(5), block_words=500).collect()
        assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert mixing.mix_report(no_docs).count() == 0
    taken = Counter()
    names = {r.doc_id: r.source for r in many.collect()}
    for r in mixing.mix_report(many, block_words=500).collect():
        taken[names[r.doc_id]] += r.taken
    sizes = Counter()
    for r in many.collect():
        sizes[r.source] += len(r.text.split())
    for s, t in targets(sizes).items():
        assert abs(taken[s] - t) <= 45
    mix = mixing.mix_documents(many, block_words=500, shards=8)
    words = Counter()
    for r in mix.collect():
        words[r.source] += len(r.text.split())
        assert 0 <= r.mix_shard < 8
    assert words == taken
    assert mix.columns[: len(many.columns)] == many.columns
    assert mix.select("doc_id", "mix_copy").distinct().count() == mix.count()


@pytest.mark.parametrize("fan", [64, 2])
def test_splitting_tree_keeps_quotas(spark, fan):
    quotas = {0: 40, 1: 7, 2: 0, 3: 100_000, 4: 1}
    rows = spark.createDataFrame(list(quotas.items()), "sid long, quota long")
    parts = mixing.split_quotas(rows, 8, seed=3, fan=fan).collect()
    by_shard, runs = Counter(), {s: [] for s in quotas}
    for r in parts:
        by_shard[r.shard] += r.quota
        runs[r.sid].append((r.start, r.start + r.quota))
    assert set(by_shard) == set(range(8)) and max(by_shard.values()) - min(by_shard.values()) <= 3
    for s, own in runs.items():
        # the shards' runs are disjoint and leave nothing out
        ends = [0, *(x for run in sorted(own) for x in run), quotas[s]]
        assert ends[::2] == ends[1::2]


def test_the_tree_decides_what_is_taken(spark, monkeypatch):
    many = frame(spark, [(i, prose(i, 20), "ab"[i % 2]) for i in range(200)])
    before = {r.doc_id: (r.taken, r.n_shards) for r in mixing.mix_report(many, block_words=100, shards=8).collect()}
    shards = {r.doc_id: r.shards for r in mixing.mix_documents(many, block_words=100, shards=8).groupBy("doc_id").agg(F.collect_set("mix_shard").alias("shards")).collect()}
    assert {k: n for k, (_, n) in before.items() if n} == {k: len(v) for k, v in shards.items()}
    one = lambda q, *_: q.select("sid", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("start"), F.lit(1).cast("long").alias("quota"))
    monkeypatch.setattr(mixing, "split_quotas", one)
    assert {r.doc_id: (r.taken, r.n_shards) for r in mixing.mix_report(many, block_words=100, shards=8).collect()} != before


@pytest.mark.parametrize("units, total, drawn", [(4, 10, 5), (0, 9, 3), (9, 9, 3), (900, 60_000, 30_000), (20_000, 70_000, 35_000)])
def test_hypergeometric_is_exact(spark, units, total, drawn):
    """Narrow and wide draws against the distribution itself, by its deciles."""
    n = 6_000
    whole = lambda x: F.lit(x).cast("long")
    draws = spark.range(n).select(mixing.hypergeometric(whole(units), whole(total), whole(drawn), F.col("id")).alias("x"))
    seen = Counter(r.x for r in draws.collect())
    lowest, highest = max(0, drawn - (total - units)), min(units, drawn)
    choose = lambda a, b: lgamma(a + 1) - lgamma(b + 1) - lgamma(a - b + 1)
    p = [exp(choose(units, x) + choose(total - units, drawn - x) - choose(total, drawn)) for x in range(lowest, highest + 1)]
    assert lowest <= min(seen) and max(seen) <= highest
    done, start, cuts = 0.0, lowest, []
    for x, q in enumerate(p, lowest):
        done += q
        if done >= 0.1 or x == highest:
            cuts.append((start, x, done))
            done, start = 0.0, x + 1
    for lo, hi, q in cuts:
        assert abs(sum(seen[x] for x in range(lo, hi + 1)) / n - q) <= 5 * (q * abs(1 - q) / n) ** 0.5 + 1e-9


def test_more_sources_than_one_draw_takes(spark):
    many = frame(spark, [(i, prose(i, 8), f"s{i % 150}") for i in range(900)])
    sizes = Counter()
    for r in many.collect():
        sizes[r.source] += len(r.text.split())
    taken, names, want = Counter(), {r.doc_id: r.source for r in many.collect()}, targets(sizes)
    for r in mixing.mix_report(many, block_words=20, shards=4).collect():
        taken[names[r.doc_id]] += r.taken
        assert abs(r.target - want[names[r.doc_id]]) < 1e-6
    assert all(abs(taken[s] - t) <= 8 for s, t in want.items())


def test_urls(spark):
    urls = {
        "http://www.example.com/en/a?x=/es/": ("www.example.com", "/en/a", "www.example.com/en/", "allow"),
        "https://a.b.Example.COM/en/": ("a.b.example.com", "/en/", "example.com/en/", "block"),
        "https://example.com/enx": ("example.com", "/enx", "com/", "allow"),
        "http://x.net/es/1#f": ("x.net", "/es/1", "net/es/", "block"),
        "http://x.net": ("x.net", "", None, "allow"),
        "http://subnet/es/": ("subnet", "/es/", None, "allow"),
        "ftp://net/fr/": ("net", "/fr/", "net/fr/", "block"),
        "no scheme": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "http:///path": ("", "/path", None, "allow"),
        "http://com/" + "a/" * 3000: ("com", "/" + "a/" * 3000, "com/", "allow"),
    }
    rows = [(i, u, "h", "clash") for i, u in enumerate(urls)] + [(99, "http://x.net/es/1#f", "h", "clash")]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string, host string")
    got = url_filter.judge_urls(pages, url_filter.rule_table(spark, url_filter.RULES)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == urls[r.url]
    assert url_filter.judge_urls(pages.limit(0), url_filter.rule_table(spark, url_filter.RULES)).count() == 0


def test_rule_paths_need_no_slash(spark):
    pages = spark.createDataFrame([(1, "http://a.org/private-x"), (2, "http://a.org/p")], "page_id int, url string")
    rules = url_filter.rule_table(spark, [("block", "a.org", "/pri"), ("allow", "org", "/")])
    assert {r.page_id: r.rule for r in url_filter.judge_urls(pages, rules).collect()} == {1: "a.org/pri", 2: "org/"}
