"""Tables that every operator must cope with."""

from __future__ import annotations

import pytest

from .helpers import SCHEMA, make_texts


@pytest.fixture(scope="session")
def rows():
    texts = make_texts()
    out = [(7 * i - 20, t, ["en", "de", None][i % 3], "hot" if i % 3 else f"s{i % 5}", None if t is None else len(t), "a", "b", "c", "d", "e", "f") for i, t in enumerate(texts)]
    out.append((None, texts[3], None, None, None, *"abcdef"))
    out += [out[4], out[4]]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    """Nulls in any column, empty and long texts, repeated rows, and columns with clashing names."""
    path = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
