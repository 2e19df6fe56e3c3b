"""Operators for preparing language-model training data.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.  ``queries`` and
``oracle_sql`` are what ``__spark_entry__.py`` registers.
"""

from __future__ import annotations

from .registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
