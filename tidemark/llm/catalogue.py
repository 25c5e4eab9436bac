"""The queries of this subpackage and, where SQL can express one, the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontamination, html, language, licenses, line_dedup, mixing, quality, simhash, token_counts, toxicity

MODULES = (quality, decontamination, mixing, language, token_counts, toxicity, line_dedup, html, simhash, licenses)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for module in MODULES for name, f in vars(module).items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in getattr(module, "SQL", {}).items()}
