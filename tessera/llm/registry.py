"""Registered queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import (
    conversation_trie,
    dart_minhash,
    fp_ranking,
    html_text,
    importance,
    language,
    license_scan,
    line_rules,
    packing,
    phrase_index,
    substring_dedup,
    toxicity,
    warc,
)

MODULES = (
    warc, substring_dedup, packing, importance, phrase_index, language, line_rules, dart_minhash, toxicity, html_text,
    license_scan, fp_ranking, conversation_trie,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
