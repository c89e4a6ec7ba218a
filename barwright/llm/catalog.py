"""Registered queries of this sub-package and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules of ``barwright.llm`` with a ``NAME``, a ``query`` and perhaps an ``ORACLE_SQL``.
MODULES = ("op1_ann", "op2_lm", "op3_jaccard", "op4_chat", "op5_quality", "op6_secrets", "op7_bpe", "op8_substrings", "op9_mixing", "op10_html")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [import_module(f"barwright.llm.queries.{m}") for m in MODULES]
    return {m.NAME: m.query for m in found}


def oracle_sql() -> dict[str, str]:
    found = [import_module(f"barwright.llm.queries.{m}") for m in MODULES]
    return {m.NAME: m.ORACLE_SQL for m in found if getattr(m, "ORACLE_SQL", None)}
