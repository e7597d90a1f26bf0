"""Secret scans over a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived: an OR of alternatives, each the AND of the
trigrams that any match of it must hold. The index keeps a posting (trigram, document) for every document and trigram that
some rule asks for. Intersecting postings names the candidate documents of each rule; only those are verified with the
expression itself. A rule without mandatory trigrams in some alternative (such as a run of hexadecimal digits) has no query
and scans every document.

Postings stay rows: no list of a frequent trigram is ever gathered. Documents are named by a hash of id and text; a hash that
two documents share can only add candidates, never lose one.

Defined cases: a null text counts as empty; positions are code points, end exclusive; matches are leftmost and do not overlap
within a kind, and a match that fails its check is dropped and not retried; rows that repeat give equal results; an empty
table gives an empty result; documents without spans have an empty span list, whose digest is that of the empty string.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product
from re import _constants as op
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomsheet.llm.store import stored


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Of its matches those stay whose ``group`` has at least ``least`` characters."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1
    base: bool = False
    any_case: bool = False


# The base kinds and the public formats of some access tokens.
RULES = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        12,
        True,
        True,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, True),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16, True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)
#: A class or repetition with more choices than this ends a literal run.
MOST_CHOICES = 8


def _choices(items) -> list[str] | None:
    """The characters of a small class."""
    found: list[str] = []
    for kind, value in items:
        if kind is op.LITERAL:
            found.append(chr(value))
        elif kind is op.RANGE and value[1] - value[0] < MOST_CHOICES:
            found += map(chr, range(value[0], value[1] + 1))
        else:
            return None
    return found if len(found) <= MOST_CHOICES else None


def _runs(parsed) -> list[list[str | None]]:
    """The alternatives of an expression, each a list of literals, with None where anything may stand."""
    ways: list[list[str | None]] = [[]]
    for kind, value in parsed:
        if kind is op.LITERAL:
            more: list[list[str | None]] = [[chr(value)]]
        elif kind is op.IN and (found := _choices(value)) is not None:
            more = [[c] for c in found]
        elif kind is op.BRANCH:
            more = [w for one in value[1] for w in _runs(one)]
        elif kind is op.SUBPATTERN:
            more = _runs(value[-1])
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[0] == value[1] <= MOST_CHOICES:
            inner = _runs(value[2])
            more = [sum(w, []) for w in product(inner, repeat=value[0])] if len(inner) ** value[0] <= MOST_CHOICES else [[None]]
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[:2] == (0, 1) and len(inner := _runs(value[2])) == 1 and None not in inner[0]:
            more = [[], inner[0]]
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[0] >= 1:
            more = [[*w, None, *w] for w in _runs(value[2])] if len(_runs(value[2])) == 1 else [[None]]
        elif kind is op.AT:
            more = [[]]
        else:
            more = [[None]]
        if len(ways) * len(more) > 64:
            more = [[None]]
        ways = [[*a, *b] for a in ways for b in more]
    return ways


def trigram_query(regex: str) -> list[frozenset[str]] | None:
    """An OR of ANDs of trigrams that every match satisfies, lower-cased; None where some alternative has no trigram."""
    clauses = set()
    for way in _runs(_parser.parse(regex)):
        literals = "".join("\0" if c is None else c for c in way).lower().split("\0")
        clause = frozenset(s[i : i + 3] for s in literals for i in range(len(s) - 2))
        if not clause:
            return None
        clauses.add(clause)
    return [c for c in clauses if not any(d < c for d in clauses)]


def trigram_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (trigram, key) of the asked trigrams, without regard to case; one row a document and trigram."""
    # lower-cased once, before the list of trigrams is made
    low = docs.select(_key().alias("key"), F.lower("text").alias("low"))
    held = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams)))
    return stored(low.select("key", F.explode(held).alias("trigram")).distinct(), "trigram-postings")


def _key() -> Column:
    return F.xxhash64("doc_id", "text")


def candidates(postings: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(key, kinds): the documents whose postings satisfy a rule's query."""
    terms = [
        F.struct(F.lit(r.kind).alias("kind"), F.lit(i).alias("clause"), F.lit(len(c)).alias("terms"), F.lit(t).alias("trigram"))
        for r in rules
        for i, c in enumerate(trigram_query(r.regex) or [])
        for t in sorted(c)
    ]
    query = postings.sparkSession.range(1).select(F.inline(F.array(*terms)))
    met = postings.join(F.broadcast(query), "trigram").groupBy("key", "kind", "clause", "terms").count()
    return met.where("count = terms").groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def _spans(rule: Rule, order: int, text: Column) -> Column:
    """All checked matches as (start, order, kind, end): pieces between matches and the matches give the positions."""
    pattern = F.lit(rule.regex)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    checked = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else matches
    rows = F.arrays_zip(matches.alias("m"), F.split(text, rule.regex, -1).alias("p"), checked.alias("g"))
    span = "struct<start:bigint,order:int,kind:string,end:bigint>"

    def add(a: Column, r: Column) -> Column:
        start = a["at"] + F.length(r["p"])
        end = start + F.length(r["m"])
        one = F.struct(start.alias("start"), F.lit(order).alias("order"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        out = F.when(F.length(r["g"]) >= rule.least, F.concat(a["out"], F.array(one))).otherwise(a["out"])
        return F.struct(end.alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{span}>").alias("out"))
    found = F.aggregate(F.filter(rows, lambda r: r["m"].isNotNull()), start, add, lambda a: a["out"])
    return F.when(F.regexp_like(text, pattern), found).otherwise(F.array().cast(f"array<{span}>"))


def _joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """A row per document: doc_id, a count for each base kind, base_sha256 and spans."""
    trigrams = sorted({t for r in rules for c in trigram_query(r.regex) or [] for t in c})
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = candidates(trigram_index(texts, trigrams), rules).withColumnRenamed("key", "found")
    rows = texts.join(found, _key() == F.col("found"), "left")
    none = F.array().cast("array<struct<start:bigint,order:int,kind:string,end:bigint>>")
    parts = {}
    for i, r in enumerate(rules):
        asked = F.lit(True) if trigram_query(r.regex) is None else F.array_contains("kinds", r.kind)
        parts[r.kind] = F.when(asked, _spans(r, i, F.col("text"))).otherwise(none)
    rows = rows.select("doc_id", *(v.alias(k) for k, v in parts.items()))
    base = [r.kind for r in rules if r.base]
    return rows.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in base),
        F.sha2(_joined(F.sort_array(F.concat(*base))).cast("binary"), 256).alias("base_sha256"),
        _joined(F.sort_array(F.concat(*(r.kind for r in rules)))).alias("spans"),
    )


def spans_by_rule(text: str, rules: tuple[Rule, ...] = RULES) -> list[tuple[int, int, str, int]]:
    """What :func:`scan_secrets` finds in one text, by Python's own expressions: for tests."""
    found = []
    for i, r in enumerate(rules):
        for m in re.finditer(r.regex, text, re.ASCII):
            if len(m[r.group]) >= r.least:
                found.append((m.start(), i, r.kind, m.end()))
    return sorted(found)
