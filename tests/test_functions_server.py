"""JSON paths, name rewriting and the HTTP endpoint."""

from __future__ import annotations

import json
import threading
import urllib.error
import urllib.request

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from zonelight.errors import UnsupportedType
from zonelight.functions import get_json_object, normal_path, register
from zonelight.functions.arrow_cast import rewrite_casts
from zonelight.functions.json_path import rewrite_paths
from zonelight.plans.names import quiet_spans
from zonelight.plans.server import SqlService, server
from zonelight.sources.resolvers import FileListResolver

DOC = '{"ship":{"name":"Ä 1","crew":[{"age":31},{"age":null}],"cargo.t":4.25},"log":[],"open":true,"empty":""}'


@pytest.mark.parametrize(
    ("path", "want"),
    [("$.ship.name", "Ä 1"), ("$.ship.crew[0].age", "31"), ("$.ship.crew[ 0 ]['age']", "31"), ('$[ "ship" ]["crew"][1].age', None), ("$['ship']['cargo.t']", "4.25"), ("$.ship.crew[2]", None), ("$.ship.crew[-1]", None), ("$.ship.crew[*].age", None), ("$.log", "[]"), ("$.open", "true"), ("$.empty", ""), ("$.ship.crew", '[{"age":31},{"age":null}]'), ("$.ship.none.name", None), ("$.", None), ("$..name", None), ("ship.name", None), ("", None)],
)
def test_json_paths(spark, path, want):
    row = spark.range(1).select(get_json_object(F.lit(DOC), path).alias("v"), get_json_object(F.lit("no json"), path).alias("bad"), get_json_object(F.lit(None).cast("string"), path).alias("none")).first()
    assert (row["v"], row["bad"], row["none"]) == (want, None, None)


def test_json_paths_from_a_column(spark):
    paths = ["$.ship.name", '$[ "ship" ]["name"]', "$.ship.crew[ 00 ].age", "$.ship.crew[*].age", "ship.name", "$..name", None, "$['ship']['cargo.t']"]
    frame = spark.createDataFrame([(DOC, p) for p in paths], "doc string, path string")
    want = ["Ä 1", "Ä 1", "31", None, None, None, None, "4.25"]
    assert [r[0] for r in frame.select(get_json_object("doc", F.col("path"))).collect()] == want
    frame.createOrReplaceTempView("doc_paths")
    sql = rewrite_paths("SELECT get_json_object(doc, concat(path, '')) AS v FROM doc_paths", [(40, 42)])
    assert sorted(str(r["v"]) for r in spark.sql(sql).collect()) == sorted(map(str, want))


def test_casts_to_arrow_types(spark):
    import datetime as dt

    one = lambda sql: spark.sql("SELECT " + rewrite_casts(sql, quiet_spans(sql)) + " AS v").first()["v"]
    assert one("arrow_cast(1600000000123456, 'Timestamp(Microsecond, None)')") == dt.datetime(2020, 9, 13, 12, 26, 40, 123456)
    assert one("arrow_cast(-1, 'Timestamp(Second, None)')") == dt.datetime(1969, 12, 31, 23, 59, 59)
    assert one("arrow_cast('7', 'Int64') + 1") == 8
    assert str(one("arrow_cast(1.239, 'Decimal128(10, 2)')")) == "1.24"
    assert one("concat('arrow_cast(1)', arrow_cast(2, 'Utf8'))") == "arrow_cast(1)2"
    with pytest.raises(UnsupportedType):
        one("arrow_cast(1, 'Int77')")


def test_normal_path():
    assert normal_path("$.a[ 2 ]['b']") == "$['a'][2]['b']"
    assert normal_path("a") is None


def test_user_functions(spark):
    register(spark, {"twice": F.pandas_udf(lambda s: s * 2, "long")})
    assert spark.sql("SELECT twice(id) AS v FROM range(3)").agg(F.sum("v")).first()[0] == 6


@pytest.fixture(scope="module")
def endpoint(spark, tmp_path_factory):
    f = str(tmp_path_factory.mktemp("t") / "t.parquet")
    pq.write_table(pa.table({"a": [1, 2, 3], "b": ["x", None, "z"], "__row_id": [7, 8, 9]}), f)
    service = SqlService(spark, lambda tables: FileListResolver({k: [f] for k, (_, dataset) in tables.items() if dataset == "good"}))
    http = server(service, "127.0.0.1", 0)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}"
    http.shutdown()


def post(url, body):
    request = urllib.request.Request(url + "/sql", json.dumps(body).encode() if isinstance(body, dict) else body, {"Content-Type": "application/json"})
    try:
        with urllib.request.urlopen(request, timeout=60) as r:
            return r.status, json.load(r)
    except urllib.error.HTTPError as e:
        return e.code, json.load(e)


def test_endpoint(endpoint):
    with urllib.request.urlopen(endpoint + "/health", timeout=10) as r:
        assert r.read() == b"ok"
    status, out = post(endpoint, {"sql": "SELECT * FROM T ORDER BY a", "tables": {"T": {"dataset_id": "good"}}, "limit": 5, "user": "u"})
    assert status == 200
    assert out == {"columns": [{"name": "a", "type": "bigint"}, {"name": "b", "type": "string"}], "rows": [{"a": 1, "b": "x"}, {"a": 2}, {"a": 3, "b": "z"}]}
    status, out = post(endpoint, {"sql": "SELECT a FROM t WHERE a > 9", "tables": {"t": {"dataset_id": "good"}}})
    assert (status, out["rows"], out["columns"][0]["name"]) == (200, [], "a")
    assert post(endpoint, {"sql": "SELECT * FROM hidden", "tables": {}})[0] == 400
    assert post(endpoint, {"sql": "SELEC", "tables": {}})[0] == 400
    assert post(endpoint, {"sql": "DROP TABLE t", "tables": {}})[0] == 400
    assert post(endpoint, b"{")[0] == 400


def test_bind_address(spark, monkeypatch):
    monkeypatch.setenv("ZONELIGHT_BIND", "127.0.0.1:0")
    monkeypatch.setenv("PORT", "1")
    http = server(SqlService(spark, lambda t: FileListResolver({})))
    assert http.server_address[0] == "127.0.0.1"
    http.server_close()
