"""The thin queries op1 to op10 over the driver's tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, language_id, line_dedup, near_dedup, packing, quality, secret_scan, sharding, url_filter

#: Fixed rules of op1: host, path, verdict.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_read(spark, sf_dir, "pages"), URL_RULES)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.balanced_shards(_read(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, how many are deleted, and which (runs of line numbers from 0)."""
    found = line_dedup.deletions(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", F.size("deleted").cast("long").alias("n_deleted"), line_dedup.spans("deleted").alias("deleted_lines"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items found in documents, with place, edits and similarity."""
    found = decontaminate.leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.drop("row_hash")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets(_read(spark, sf_dir, "documents"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(_read(spark, sf_dir, "documents"), width=2)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.decide(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), vocabulary())


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_features", "log_weight", "sample_key", "kept")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs, "doc_id"), ["doc_id"], F.col("source"))


def pages_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator with all its evidence, over web pages."""
    pages = _read(spark, sf_dir, "pages").select("page_id", language_id.host_of(F.col("url")).alias("host"), language_id.declared_language(F.col("html")).alias("markup"), language_id.page_text(F.col("html")).alias("text"))
    model = language_id.fit(_read(spark, sf_dir, "documents"), "doc_id")
    return language_id.identify(pages, model, ["page_id"], F.col("host"), F.col("markup"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_url_filter, op2_sharding, op3_line_dedup, op4_decontaminate, op5_secret_scan, op6_near_dedup, op7_exact_dedup, op8_packing, op9_quality, op10_language_id, pages_language]
    return {f.__name__: f for f in found}


OP1_SQL = r"""
WITH u AS (
  SELECT page_id, coalesce(nullif(strpos(url, '://'), 0), 0) AS pos, coalesce(url, '') AS url FROM pages
), r AS (
  SELECT page_id, CASE WHEN pos = 0 THEN '' ELSE regexp_extract(substr(url, pos + 3), '^[^?#]*') END AS rest FROM u
), p AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         substr(rest, length(regexp_extract(rest, '^[^/]*')) + 1) AS path FROM r
), j AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
  END AS rule FROM p
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict
FROM j
"""

OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": OP1_SQL, "op7_exact_dedup": OP7_SQL}
