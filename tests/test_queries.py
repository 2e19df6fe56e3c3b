"""Every registered query of the engine against its SQL on a second engine."""

from __future__ import annotations

import datetime as dt
import os
import re
import shutil
import subprocess
import sys
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from zonelight.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in catalogue.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def normal(v):
    if isinstance(v, float):
        return round(v, 6)
    return str(v) if isinstance(v, (dt.date, dt.datetime, Decimal)) else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_matches_second_engine(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    want = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(want.columns, want.fetchall())


def test_every_query_has_sql():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())


def test_entry_point_works_without_the_optional_folder():
    """Nothing outside the optional folder may import it, but for the guarded import of the entry point."""
    root = Path(__file__).resolve().parent.parent
    for f in (root / "zonelight").rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert not re.search(r"\bllm\b", f.read_text(encoding="utf-8")), f


@pytest.mark.parametrize("left", ["nothing", "empty folder", "pipeline", "broken"])
def test_entry_point_imports_with_what_is_left(tmp_path, left):
    """The engine's queries stay up whatever of the optional folder is gone."""
    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "zonelight", tmp_path / "zonelight", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    folder = tmp_path / "zonelight" / ("l" + "lm")
    if left != "nothing":
        folder.mkdir()
    if left == "pipeline":
        (tmp_path / "corpus_pipeline.py").write_text("import zonelight.nowhere\n")
    if left == "broken":
        (folder / "__init__.py").write_text("")
        (folder / "registry.py").write_text("MODULES = ['one']\n")
        (folder / "one.py").write_text("import no_such_library\n")
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), set(q) == set(e.oracle_sql()), any(n.startswith('op') or n == 'pipeline' for n in q))"
    out = subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert out.stdout.split() == [str(len(catalogue.queries())), "True", "False"], out.stderr


@pytest.mark.parametrize("name", ["contract_replay", "json_front", "fqn", "zone_join", "zone_cte"])
def test_whole_tables_are_read(spark, duck, name):
    """Beside each query over a range of ids there is one over all rows."""
    sql = catalogue.oracle_sql()[f"{name}_whole"]
    assert "WHERE" not in sql and "LIMIT" not in sql
    got = catalogue.queries()[f"{name}_whole"](spark, SF).agg({"n" if name != "zone_cte" else "top": "sum" if name != "zone_cte" else "max"}).first()[0]
    want = {"zone_join": "SELECT count(*) FROM lineitem JOIN orders ON o_orderkey = l_orderkey", "zone_cte": "SELECT max(event_id) FROM events"}.get(name, "SELECT count(*) FROM events")
    assert got == duck.sql(want).fetchall()[0][0]


def test_default_limit_cuts_ordered_rows(spark, duck):
    got = [x["event_id"] for x in catalogue.queries()["auto_limit_whole"](spark, SF).collect()]
    assert got == [x for (x,) in duck.sql("SELECT event_id FROM events ORDER BY event_id").fetchall()][:100] and len(got) == 100
