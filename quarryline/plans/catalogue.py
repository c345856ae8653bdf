"""All registered evidence queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarryline.plans import aggs, decodes, evidence, graphs, joins, rules, texts

FLAGSHIP = "evidence_window_resolution"
MODULES = (joins, aggs, graphs, texts, rules, evidence, decodes)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query.run for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: query.sql for module in MODULES for name, query in module.QUERIES.items() if query.sql}
