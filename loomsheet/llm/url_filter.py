"""URL filter lists by host-suffix and path-prefix expressions.

Each URL expands into the expressions that a rule for it could have: every suffix of its host with every prefix of its path
that ends in a slash. Expressions meet the rules by an equi-join on a short hash prefix of their SHA-256; the full digests
then confirm the match, and of the rules that fit, the longest wins. Expressions deeper than any rule are never made.

The work is done once per distinct URL, so repeated URLs cost nothing more.

Defined cases: a null URL or one without "://" has an empty host and path and fits no rule; a path that is empty starts with
no rule's path; a rule's path need not end in a slash (the part after its last slash is compared on the joined rows); of
rules of equal length the one with the longer host wins, then the first in order of text; a rule given twice with two
verdicts counts as block; without a fitting rule the verdict is ``default``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomsheet.llm.exact_dedup import ascii_lower

#: (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Hexadecimal digits of the joined hash prefix.
SHORT = 8


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty where the URL is null or has no '://'."""
    part = lambda i: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", i), F.lit(""))
    return ascii_lower(part(1)), part(2)


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, path).cast("binary"), 256)


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    one = lambda r: F.struct(*(F.lit(v).alias(k) for k, v in zip(("verdict", "rule_host", "rule_path"), r, strict=True)))
    return prepare_rules(spark.range(1).select(F.inline(F.array(*map(one, rules)))))


def prepare_rules(rules: DataFrame) -> DataFrame:
    """Rules keyed by the expression of their host and the last slash of their path."""
    host, path = ascii_lower(F.col("rule_host")), F.col("rule_path")
    rules = rules.select("verdict", host.alias("rule_host"), path.alias("rule_path")).groupBy("rule_host", "rule_path")
    rules = rules.agg(F.max("verdict").alias("verdict"))
    base = F.regexp_extract("rule_path", r"(?s)^(.*/)?", 1)
    digest = _digest(F.col("rule_host"), base)
    return rules.select(
        "verdict",
        "rule_host",
        "rule_path",
        F.concat("rule_host", "rule_path").alias("rule"),
        digest.alias("rule_digest"),
        F.substring(digest, 1, SHORT).alias("short"),
        F.size(F.split("rule_host", r"\.")).alias("labels"),
        (F.length(base) - F.length(F.replace(base, F.lit("/"), F.lit("")))).alias("depth"),
    )


def expressions(urls: DataFrame, most_labels: int, most_depth: int) -> DataFrame:
    """A row for each host suffix of at most most_labels labels and path prefix of at most most_depth slashes."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(F.size("labels"), F.lit(most_labels))),
        lambda n: F.array_join(F.slice("labels", -n, n), "."),
    )
    steps = F.slice("steps", F.lit(1), F.least(F.size("steps") - 1, F.lit(most_depth)))
    prefixes = F.when(
        F.size("steps") > 1,
        F.transform(
            F.sequence(F.lit(1), F.size(steps)), lambda n: F.concat(F.array_join(F.slice("steps", F.lit(1), n), "/"), F.lit("/"))
        ),
    )
    rows = urls.withColumns({"labels": labels, "steps": F.split("path", "/")})
    rows = rows.select("url", "path", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes"))
    rows = rows.select("url", "path", "suffix", F.explode("prefixes").alias("prefix"))
    return rows.select("url", "path", _digest(F.col("suffix"), F.col("prefix")).alias("digest"))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """pages' rows with host, path, rule and verdict; rules as :func:`prepare_rules` gives them."""
    host, path = url_parts(F.col("url"))
    urls = pages.select("url").where("url is not null").distinct().withColumns({"host": host, "path": path})
    bounds = rules.agg(F.max("labels").alias("labels"), F.max("depth").alias("depth")).first()
    made = expressions(urls.where("path != ''"), bounds["labels"] or 1, bounds["depth"] or 1)
    met = made.withColumn("short", F.substring("digest", 1, SHORT)).join(rules, "short")
    fits = met.where((F.col("digest") == F.col("rule_digest")) & F.startswith("path", F.col("rule_path")))
    rank = F.struct(
        F.length("rule").alias("n"), F.length("rule_host").alias("h"), F.col("rule"), F.col("verdict").alias("verdict")
    )
    best = fits.groupBy("url").agg(F.max(rank).alias("__ls_best")).withColumnRenamed("url", "__ls_url")
    host, path = url_parts(F.col("url"))
    own = [pages[c] for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    return pages.join(best, F.col("url") == F.col("__ls_url"), "left").select(
        *own,
        host.alias("host"),
        path.alias("path"),
        F.col("__ls_best.rule").alias("rule"),
        F.coalesce("__ls_best.verdict", F.lit(default)).alias("verdict"),
    )
