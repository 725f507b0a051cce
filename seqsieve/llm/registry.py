"""The corpus operators as registered queries, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqsieve.llm import audit, bpe, caps, jaccard, langid, licenses, lm, mixing, nearest, pii, repair, risk, urls
from seqsieve.llm.common import documents

URL_RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]
RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(documents(spark, sf_dir))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(documents(spark, sf_dir, "pages"), URL_RULES)


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(documents(spark, sf_dir)))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(documents(spark, sf_dir), width=3, share=(9, 10)).drop("row_hash")


def op6_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.near_vectors(documents(spark, sf_dir, "embeddings"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path(RANKS)
    return bpe.round_trip(documents(spark, sf_dir), ranks, public_tokenizers.PATTERN)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(licenses.scan_licenses(documents(spark, sf_dir)))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.judge(documents(spark, sf_dir), documents(spark, sf_dir, "labels")).drop("n_lines")


def op10_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_corpus(documents(spark, sf_dir))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(documents(spark, sf_dir, "conversations"))


def op12_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(documents(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.interactions(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    operators = (
        op1_mix_sources, op2_language_id, op3_url_filter, op4_personal_data, op5_ngram_jaccard,
        op6_cap_filters, op7_byte_bpe, op8_license_scan, op9_quality_rules, op10_recurrent_lm,
        op11_conversation_repair, op12_cross_polytope, op13_filter_audit,
    )
    return {f.__name__: f for f in operators}


_URL_SQL = r"""
WITH parts AS (
    SELECT page_id, strpos(coalesce(url, ''), '://') AS mark,
        substring(coalesce(url, ''), strpos(coalesce(url, ''), '://') + 3) AS rest
    FROM pages),
split AS (
    SELECT page_id,
        CASE WHEN mark = 0 THEN '' ELSE
            translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS host,
        CASE WHEN mark = 0 THEN '' ELSE regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) END AS path
    FROM parts),
rules(verdict, rule_host, rule_path) AS (VALUES
    ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
    ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fits AS (
    SELECT page_id, verdict, rule_host || rule_path AS rule,
        row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC, verdict DESC) AS place
    FROM split JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT s.page_id, s.host, s.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM split s LEFT JOIN (SELECT * FROM fits WHERE place = 1) f ON s.page_id = f.page_id
"""


_WORDS_SQL = r"list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '')"


def _audit_sql() -> str:
    names = ", ".join(f"('{order}', {step}, {past}, {number})" for order, step, past, number in audit.orders())
    return f"""
WITH docs AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
judged AS (
    SELECT doc_id, part, {_WORDS_SQL} AS words, text,
        coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS copy
    FROM docs),
masks AS (
    SELECT part,
        CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
        + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
        + CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text) THEN 4 ELSE 0 END
        + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
        + CASE WHEN copy THEN 16 ELSE 0 END AS mask,
        doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) AS good,
        doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) AS toxic
    FROM judged),
counted AS (
    SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM masks GROUP BY part, mask),
steps(filter_order, step, past, number) AS (VALUES {names}),
sums AS (
    SELECT part, filter_order, step, number,
        sum(CASE WHEN mask & (past | (1 << number)) = 0 THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN mask & past = 0 AND mask & (1 << number) <> 0 THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN mask & past <> 0 AND mask & (1 << number) <> 0 THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN mask = (1 << number) THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN mask & past = 0 AND mask & (1 << number) <> 0 THEN good ELSE 0 END) AS good_lost,
        sum(CASE WHEN mask & past = 0 AND mask & (1 << number) <> 0 THEN toxic ELSE 0 END) AS toxic_lost
    FROM counted CROSS JOIN steps GROUP BY part, filter_order, step, number)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
    CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
    CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, number) AS BIGINT) AS shapley
FROM sums
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_url_filter": _URL_SQL, "op13_filter_audit": _audit_sql()}
