"""op8: passages of 13 words that also start in an earlier document, cut out of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.llm.substrings import remove_repeats

NAME = "op8_substring_dedup"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS MATERIALIZED (
  SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g FROM w, unnest(range(1, len(ws) - 11)) t(i) WHERE len(ws) >= 13),
f AS (SELECT g, min(doc_id) AS first_doc FROM win GROUP BY g),
gone AS (
  SELECT DISTINCT win.doc_id, i + j AS p FROM win JOIN f USING (g) CROSS JOIN range(13) r(j) WHERE win.doc_id > first_doc),
e AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
k AS (
  SELECT e.doc_id, count(gone.p) AS n_removed, string_agg(word, ' ' ORDER BY e.p) FILTER (WHERE gone.p IS NULL) AS kept
  FROM e LEFT JOIN gone ON gone.doc_id = e.doc_id AND gone.p = e.p GROUP BY e.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON k.doc_id = w.doc_id
"""
