"""op2: stupid-backoff scores of all documents by trigrams, each under the rest of the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.llm.ngram_lm import stupid_backoff

NAME = "op2_stupid_backoff"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = stupid_backoff(docs)
    return out.select("doc_id", "n_words", "n_backed_off", F.round("log_score", 6).alias("log_score"), F.round("per_word", 6).alias("per_word"))


#: c1 to c3: occurrences of the last one to three words outside the document; h1, h2: those of their contexts.
ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
e AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
g AS (
  SELECT doc_id, p, word, lag(word) OVER o AS prev, lag(word, 2) OVER o AS prev2 FROM e WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
x AS (
  SELECT doc_id, p, count(*) OVER () AS total, count(*) OVER (PARTITION BY doc_id) AS size,
         count(*) OVER (PARTITION BY word) - count(*) OVER (PARTITION BY doc_id, word) AS c1,
         count(*) OVER (PARTITION BY prev, word) - count(*) OVER (PARTITION BY doc_id, prev, word) AS c2,
         count(*) OVER (PARTITION BY prev2, prev, word) - count(*) OVER (PARTITION BY doc_id, prev2, prev, word) AS c3
  FROM g),
y AS (SELECT *, lag(c1) OVER o AS h1, lag(c2) OVER o AS h2, least(p - 1, 2) AS depth FROM x WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
z AS (SELECT *, CASE WHEN p > 2 AND c3 > 0 AND h2 > 0 THEN 2 WHEN p > 1 AND c2 > 0 AND h1 > 0 THEN 1 ELSE 0 END AS level FROM y),
s AS (
  SELECT doc_id, size, depth > level AS backed,
         CASE level WHEN 2 THEN ln(c3) - ln(h2) WHEN 1 THEN ln(c2) - ln(h1) ELSE ln(greatest(c1, 1)) - ln(greatest(total - size, 1)) END + (depth - level) * ln(0.4) AS l
  FROM z)
SELECT w.doc_id, coalesce(any_value(s.size), 0)::BIGINT AS n_words, coalesce(sum(s.backed::INT), 0)::BIGINT AS n_backed_off,
       round(coalesce(sum(s.l), 0), 6) AS log_score, round(sum(s.l) / any_value(s.size), 6) AS per_word
FROM w LEFT JOIN s ON s.doc_id = w.doc_id GROUP BY w.doc_id
"""
