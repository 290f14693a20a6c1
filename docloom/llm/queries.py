"""Registered queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from docloom.llm import op1_secrets, op2_brown, op3_license, op4_minhash, op5_suffix, op6_mixing, op7_quality, op8_decontaminate, op9_language, op10_lines


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op1_secrets.scan_secrets(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_layers", "n_refused")


def op2_brown_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_brown.score(_table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_license.scan_licenses(_table(spark, sf_dir, "documents"))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_minhash.near_dedup(_table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_suffix.removal(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_mixing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_mixing.mix(_table(spark, sf_dir, "documents"))


def op7_quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = op8_decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return hits.select("doc_id", "n_words", "n_hit", "n_items", F.sha2("item_ids", 256).alias("items_sha256"), "contaminated")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_language.identify_pages(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = op10_lines.line_dedup(_table(spark, sf_dir, "documents"), min_words=0, bits=None)
    return lines.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_secret_scan, op2_brown_score, op3_license_scan, op4_minhash_dedup, op5_substring_dedup, op6_mixing_query, op7_quality_query, op8_decontamination, op9_language_id, op10_line_dedup)
    return {f.__name__.removesuffix("_query"): f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op4_minhash_dedup": NEAR_SQL, "op5_substring_dedup": REPEATS_SQL, "op6_mixing": op6_mixing.sql(), "op8_decontamination": op8_decontaminate.SQL}


NEAR_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * n_both >= 80 * (x.n + y.n - n_both)),
r AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON r.id = e.a WHERE e.b > r.root),
c AS (SELECT id, min(root) AS component_id FROM r GROUP BY 1)
SELECT t.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, t.doc_id = component_id AS kept
FROM t LEFT JOIN n USING (doc_id) JOIN c ON c.id = t.doc_id
"""

REPEATS_SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 19), ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM t WHERE len(w) >= 20)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM g) WHERE k > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM r),
k AS (
  SELECT t.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY u.p) FILTER (WHERE c.p IS NULL) AS kept, count(c.p) AS gone
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM t) u JOIN t USING (doc_id) LEFT JOIN c ON c.doc_id = u.doc_id AND c.p = u.p GROUP BY 1)
SELECT t.doc_id, len(w)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN k USING (doc_id)
"""
