"""op6: secrets in all documents, with the ownership frequency of each value."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.llm.secret_scan import KINDS, find_secrets

NAME = "op6_secret_scan"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source"))
    names = F.array(*map(F.lit, KINDS))
    base = F.filter("findings", lambda f: f["kind"] < 3)
    line = lambda spans: F.array_join(F.transform(spans, lambda f: F.concat_ws(":", F.element_at(names, f["kind"] + 1), f["start"], f["end"])), ",")
    count = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long")
    live = F.size(F.filter("findings", lambda f: f["live"])).cast("long")
    most = lambda field: F.coalesce(F.array_max(F.transform("findings", lambda f: f[field])), F.lit(0)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("findings")).alias("spans"), live.alias("n_live"), most("owners").alias("most_owners"), most("repositories").alias("most_repositories"))


_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_PATTERNS = (("assign", _ASSIGN), ("access", "AKIA[A-Z0-9]+"), ("hex", "[0-9a-f]+"), ("token", "[A-Za-z0-9+/_=-]{20,}"))
_MATCHES = " UNION ALL ".join(
    f"SELECT doc_id, text, source, repo, {k} AS kind, regexp_extract_all(text, '{p.replace(chr(39), chr(39) * 2)}', 0) AS m, "
    f"regexp_extract_all(text, '{p.replace(chr(39), chr(39) * 2)}', {int(k == 0)}) AS v, regexp_split_to_array(text, '{p.replace(chr(39), chr(39) * 2)}') AS g FROM d"
    for k, (_, p) in enumerate(_PATTERNS)
)
ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, chr(1)) AS source, concat_ws('/', source, lang) AS repo FROM documents),
a AS ({_MATCHES}),
x AS (SELECT doc_id, text, source, repo, kind, unnest(m) AS m, unnest(v) AS v, unnest(g[1:len(m)]) AS g, generate_subscripts(m, 1) AS i FROM a WHERE len(m) > 0),
y AS (
  SELECT doc_id, text, source, repo, kind, v, sum(length(g) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop, length(m) AS size FROM x),
z AS MATERIALIZED (
  SELECT doc_id, text, source, repo, kind, v, (stop - size)::BIGINT AS start, stop::BIGINT AS stop FROM y
  WHERE CASE kind WHEN 0 THEN length(v) >= 12 WHEN 1 THEN length(v) >= 18 WHEN 2 THEN length(v) >= 16
        ELSE regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]') END),
o AS (SELECT v, count(DISTINCT source) AS owners, count(DISTINCT repo) AS repos FROM (SELECT v, text, min(source) AS source, min(repo) AS repo FROM z GROUP BY v, text) GROUP BY v),
kept AS (
  SELECT z.*, owners, repos, owners < 3 AND repos < 4 AS live FROM z JOIN o USING (v) WHERE kind < 3 OR (owners < 3 AND repos < 4 AND NOT EXISTS (
    SELECT 1 FROM z b WHERE b.doc_id = z.doc_id AND b.kind < 3 AND b.start < z.stop AND z.start < b.stop))),
s AS (SELECT *, ['assign', 'access', 'hex', 'token'][kind + 1] || ':' || start || ':' || stop AS line FROM kept)
SELECT d.doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
       sha256(coalesce(string_agg(line, ',' ORDER BY start, kind) FILTER (WHERE kind < 3), '')) AS base_sha256,
       coalesce(string_agg(line, ',' ORDER BY start, kind), '') AS spans, count(*) FILTER (WHERE live) AS n_live, coalesce(max(owners), 0)::BIGINT AS most_owners, coalesce(max(repos), 0)::BIGINT AS most_repositories
FROM d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id
"""
