"""A corpus pipeline: quality, near duplicates, secrets, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows of ``docs``. The driver of a run
writes each stage's rows as Parquet and rereads them for the next one, so a lost executor
costs no more than the stage at hand.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.llm.jaccard import jaccard_classes
from barwright.llm.mixing import apply_limits, mix_limits, quality_weight, repeated
from barwright.llm.queries.op5_quality import judged
from barwright.llm.queries.op7_bpe import digests, vocab_path
from barwright.llm.secret_scan import find_secrets, redact
from barwright.llm.words import word_count
from barwright.session import cut, discard, scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the decision list reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return judged(docs.select(*COLUMNS), labels, keep_text=True).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of copies and near copies, the one with the smallest id; null ids stay."""
    kept = jaccard_classes(docs).where(F.col("doc_id") == F.col("class_id")).select("doc_id").distinct()
    named = docs.where("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi")
    return named.select(*COLUMNS).unionByName(docs.where("doc_id IS NULL").select(*COLUMNS))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret found in their texts masked; n_chars follows."""
    found = find_secrets(docs).where(F.size("findings") > 0).select("key", "findings").dropDuplicates(["key"])
    rows = docs.withColumn("key", F.xxhash64("doc_id", "text")).join(found, "key", "left")
    masked = F.when(F.col("findings").isNull(), F.col("text")).otherwise(redact(F.col("text"), F.col("findings")))
    rows = rows.withColumn("text", masked)
    return rows.withColumn("n_chars", F.when(F.col("findings").isNull(), F.col("n_chars")).otherwise(F.length("text"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each time a document is taken.

    Texts are measured once; each is then compared with its source's limit where it is stored.
    """
    measured = docs.select("doc_id", "source", word_count(F.col("text")).alias("words"), quality_weight(F.col("text")).alias("quality"))
    limits = cut(mix_limits(measured, size=F.col("words"), quality=F.col("quality")))
    return repeated(apply_limits(docs.select(*COLUMNS), limits), COLUMNS)


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row of the mix."""
    return digests(docs, vocab_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("mix_sources", mix_sources),
    ("bpe_encode", bpe_encode),
]

#: The last stage's ids and the decision list can't be had in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each but the last is written to the shared folder and read again.

    The last stage's rows, ids and digests, are checkpointed, and the folder is removed.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch(spark, "pipeline")
    try:
        for number, (name, stage) in enumerate(STAGES):
            docs = stage(spark, docs, sf_dir)
            if number < len(STAGES) - 1:
                docs.write.parquet(f"{folder}/{number}-{name}")
                docs = spark.read.parquet(f"{folder}/{number}-{name}")
        return cut(docs)
    finally:
        discard(spark, folder)
