"""Registered queries of the text operators and the SQL of those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytebpe, decontaminate, fillmiddle, licenses, lmscore, packing, quality, qualityrules, secretscan, simhash, suffixdedup, urlfilter, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""


@_query("op9_benchmark_decontamination", rf"""
WITH doc AS (SELECT doc_id, {_WORDS} AS words FROM documents),
item AS (SELECT item_id, {_WORDS} AS words FROM benchmark),
phrase AS (
  SELECT DISTINCT item_id, least(10, len(words)) AS size, array_to_string(words[i:i + least(10, len(words)) - 1], ' ') AS phrase
  FROM (SELECT item_id, words, unnest(range(1, greatest(1, len(words) - 9) + 1)) AS i FROM item WHERE len(words) > 0)),
place AS (
  SELECT doc_id, size, unnest(range(1, len(words) - size + 2)) AS i, words
  FROM doc, (SELECT DISTINCT size FROM phrase) WHERE len(words) >= size),
found AS (SELECT doc_id, place.size, i, item_id FROM place JOIN phrase ON place.size = phrase.size AND array_to_string(words[i:i + place.size - 1], ' ') = phrase),
hit AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS word FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT doc.doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
""")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.find_contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("spans")


@_query("op10_quality_rules")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return qualityrules.apply_rules(table(spark, folder, "documents"))


@_query("op8_simhash_near_dedup")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


@_query("op6_license_scan")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, folder, "documents"))


@_query("op7_secret_scan")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return secretscan.scan_secrets(table(spark, folder, "documents"))


@_query("op1_best_fit_packing")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"))


@_query("op4_quality_classifier")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classify(table(spark, folder, "documents"))


@_query("op2_url_filter")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return urlfilter.judge_urls(table(spark, folder, "pages"))


@_query("op3_suffix_array_dedup")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return suffixdedup.remove_repeats(table(spark, folder, "documents"))


@_query("op5_lm_score")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return lmscore.score_texts(table(spark, folder, "documents"))


@_query("op11_embedding_whitening")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))


@_query("op12_fill_in_middle", r"""
WITH unit AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
cut AS (
  SELECT *, len(units) AS n, [('0x' || substr(h, i, 8))::BIGINT FOR i IN [1, 9, 17, 25]] AS r FROM unit),
part AS (
  SELECT doc_id, text, n, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
    array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix,
    CASE WHEN n = 0 OR regexp_matches(text, '<[PSM]>') OR r[3] % 100 >= 90 THEN 'plain' WHEN r[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM cut)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM part
""")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    rows = fillmiddle.fill_in_middle(table(spark, folder, "documents"))
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(fillmiddle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


@_query("op13_byte_bpe")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    rows = bytebpe.encode_texts(table(spark, folder, "documents"), decoded=True)
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
