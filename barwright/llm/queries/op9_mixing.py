"""op9: the mix of all documents at weights 1, 2, 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.llm.mixing import mix, quality_weight
from barwright.llm.words import word_count
from barwright.session import cut

NAME = "op9_mix_sources"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # texts are read once: their sizes and weights go to the shared folder, and only these are sorted and joined
    measured = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("words"), quality_weight(F.col("text")).alias("quality")))
    mixed = mix(measured, size=F.col("words"), quality=F.col("quality"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), "taken")


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS seen,
         length(regexp_replace(text, '[\x20\x09-\x0D#*$%&|<>]', '', 'g')) AS plain,
         (('0x' || substr(md5('mix-1|' || doc_id::VARCHAR), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
keyed AS (
  SELECT *, -ln(u) / CASE WHEN seen > 0 THEN 0.1::DOUBLE + 0.9::DOUBLE * (plain::DOUBLE / seen::DOUBLE) ELSE 0.1::DOUBLE END AS k FROM sized),
src AS (
  SELECT source, sum(size)::BIGINT AS z, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM keyed GROUP BY source),
wei AS (SELECT source, z, ((r - 1) % 3 + 1)::DOUBLE AS w, r FROM src),
lev AS (
  SELECT *, row_number() OVER (ORDER BY 3.0::DOUBLE * z / w, r) AS p,
         (sum(z) OVER () - 3.0::DOUBLE * coalesce(sum(z) OVER (ORDER BY 3.0::DOUBLE * z / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY 3.0::DOUBLE * z / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS l
  FROM wei),
tgt AS (
  SELECT source, z, least(w * coalesce((SELECT arg_min(l, p) FROM lev WHERE l <= 3.0::DOUBLE * z / w * (1 + 1e-12::DOUBLE)), 0.0::DOUBLE), 3.0::DOUBLE * z) AS target FROM lev),
run AS (
  SELECT k.doc_id, k.size, t.z, t.target,
         CASE WHEN t.z > 0 THEN floor(t.target / t.z + 1e-9::DOUBLE) ELSE 0 END AS epochs,
         coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.k, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM keyed k JOIN tgt t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, z AS source_size, round(target, 3) AS target,
       (size * (epochs + CASE WHEN size > 0 AND ahead + size / 2.0::DOUBLE <= target - epochs * z THEN 1 ELSE 0 END))::BIGINT AS taken
FROM run
"""
