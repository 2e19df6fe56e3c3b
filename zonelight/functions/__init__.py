"""Functions beyond Spark's own, and their registration in a session."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession

from .approx import approx_count_distinct
from .json_path import get_json_object, normal_path

__all__ = ["approx_count_distinct", "get_json_object", "normal_path", "register"]


def register(spark: SparkSession, functions: dict[str, Callable] | None = None) -> None:
    """Make user functions (plain, vectorised, aggregate or table functions) callable from a session's SQL."""
    for name, f in (functions or {}).items():
        (spark.udtf if hasattr(f, "asDeterministic") and hasattr(f, "func") and isinstance(getattr(f, "func", None), type) else spark.udf).register(name, f)
