"""op5: base statistics and the learned decision list on all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.llm.quality import BASE, base_failed, fit_quality, with_statistics

NAME = "op5_quality_rules"


def judged(docs: DataFrame, labels: DataFrame, keep_text: bool) -> DataFrame:
    """``docs`` with BASE, base_failed, rule (number of the rule that rejects, else 0) and kept."""
    rules = fit_quality(docs, labels)
    rows = with_statistics(docs, keep_text=keep_text).withColumns({"base_failed": base_failed(), "rule": rules.rule_number()})
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return judged(docs, labels, keep_text=False).select("doc_id", *BASE, "base_failed", "rule", "kept")
