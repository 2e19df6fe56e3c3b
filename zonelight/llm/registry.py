"""All queries of this folder, and their SQL where SQL can express them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Modules that define ``QUERIES`` and, where there is one, ``ORACLE_SQL``.
MODULES = ["lm_scoring", "quality", "ngram_join", "media", "pii", "mixing", "bpe", "sstable", "line_dedup", "fingerprints"]


def _modules() -> list:
    return [importlib.import_module(f"{__package__}.{name}") for name in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for m in _modules() for k, sql in getattr(m, "ORACLE_SQL", {}).items()}
