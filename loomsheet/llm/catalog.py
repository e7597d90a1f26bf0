"""The registered queries of this subpackage and, where SQL can express them, the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomsheet.llm import exact_dedup, forest, hmm, mixing, oracles, pii, repeats, secret_scan, toxicity, url_filter, winnow


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_texts(_read(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return toxicity.score_texts(docs, toxicity.train(docs, _read(spark, sf_dir, "labels")))


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_read(spark, sf_dir, "documents"), with_text=False)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(_read(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = url_filter.rule_table(spark, url_filter.RULES)
    found = url_filter.judge_urls(_read(spark, sf_dir, "pages"), rules)
    return found.select("page_id", "host", "path", "rule", "verdict")


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(_read(spark, sf_dir, "documents"))


def op7_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnow.find_contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.drop("spans", "key")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_read(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_read(spark, sf_dir, "documents"))


def op10_jaccard_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_duplicates(_read(spark, sf_dir, "documents")).drop("k1", "k2", "kept")


def queries() -> dict:
    found = {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


_OP5 = f"""
with parts as (
  select page_id, coalesce(url, '') as url from pages
), cut as (
  select page_id,
    case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as tail from parts
), named as (
  select page_id, {oracles.LOWER.format("regexp_extract(tail, '^[^/?#]*')")} as host,
    regexp_extract(tail, '^[^/?#]*([^?#]*)', 1) as path from cut
), rules(verdict, rhost, rpath) as (
  values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
    ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), fits as (
  select page_id, host, path, rhost || rpath as rule, verdict,
    row_number() over (partition by page_id order by length(rhost || rpath) desc nulls last) as place
  from named left join rules
    on (host = rhost or suffix(host, '.' || rhost)) and starts_with(path, rpath)
)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from fits where place = 1
"""

_OP9 = f"""
with t as (select doc_id, {oracles.LOWER.format("coalesce(text, '')")} as x from documents)
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
  doc_id is not distinct from max(doc_id) over same as kept, sha256(x) as text_sha256
from t window same as (partition by x)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_repeats": oracles.REPEATS,
        "op4_secret_scan": oracles.secrets(),
        "op5_url_filter": _OP5,
        "op7_winnow": oracles.WINNOW,
        "op9_exact_dedup": _OP9,
        "op10_jaccard_forest": oracles.JACCARD,
    }
