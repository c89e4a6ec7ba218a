"""op10: main text of all pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barwright.llm.style_tree import extract

NAME = "op10_html_extract"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


#: The article's blocks of pages laid out as those of the tables, by patterns; not a general extractor.
ORACLE_SQL = r"""
WITH a AS (
  SELECT page_id, url, regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's'), '</?b>', '', 'g'), '<br>', ' ', 'g') AS x FROM pages),
b AS (
  SELECT page_id, url, list_transform(string_split_regex(x, '</?(?:p|h1)>'), lambda t:
    trim(regexp_replace(replace(replace(replace(regexp_replace(t, '&amp;?', '&', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '\s+', ' ', 'g'))) AS parts FROM a),
c AS (SELECT page_id, url, array_to_string(list_filter(parts, lambda t: t <> ''), chr(10) || chr(10)) AS text FROM b)
SELECT page_id, url, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n_chars FROM c
"""
