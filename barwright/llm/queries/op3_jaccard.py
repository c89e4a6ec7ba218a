"""op3: classes and links of all documents at a five-word Jaccard similarity of 0.8 or more."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barwright.llm.jaccard import jaccard_classes

NAME = "op3_ngram_jaccard_join"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS MATERIALIZED (
  SELECT DISTINCT doc_id, gram FROM (
    SELECT doc_id, array_to_string(ws[i:i + 4], ' ') AS gram FROM w, unnest(range(1, len(ws) - 3)) t(i) WHERE len(ws) >= 5
    UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 4)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8::DOUBLE * (x.n + y.n - c) - 1e-9::DOUBLE),
s AS MATERIALIZED (SELECT a AS u, b AS v FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT doc_id AS node, doc_id AS root FROM w UNION SELECT s.v, r.root FROM reach r JOIN s ON s.u = r.node),
l AS (SELECT u, count(*) AS n FROM s GROUP BY u)
SELECT node AS doc_id, min(root) AS class_id, coalesce(any_value(l.n), 0)::BIGINT AS n_links
FROM reach LEFT JOIN l ON l.u = node GROUP BY node
"""
