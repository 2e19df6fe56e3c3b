"""The registered queries: what the engine adds, and one for each kind of relational operation.

Most run the same text on both engines; the others build on the index, the session or the functions.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..functions import approx_count_distinct, get_json_object, register
from ..operators.build import IndexField
from ..operators.rezone import rezone
from ..operators.scan import ZoneTable, python_predicates
from ..sources import synthetic
from ..sources.files import data_files
from ..sources.resolvers import FileListResolver, FixedIndex, ResolvedSnapshot
from ..sources.snapshot import snapshot_table
from .session import SessionConfig, ZoneSession

Query = Callable[[SparkSession, str], DataFrame]
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
#: Columns that the index covers, by table.
INDEXED = {
    "events": [IndexField("event_id", 1, True), IndexField("ts", 2), IndexField("user_id", 3, True), IndexField("event_type", 4), IndexField("value", 5)],
    "orders": [IndexField("o_orderkey", 1, True), IndexField("o_custkey", 2, True), IndexField("o_orderdate", 3)],
    "lineitem": [IndexField("l_orderkey", 1, True), IndexField("l_shipdate", 2), IndexField("l_quantity", 3)],
}


def _uri(sf_dir: str, name: str) -> str:
    return f"{sf_dir}/{name}.parquet"


def _index_folder(spark: SparkSession) -> str:
    """Where sidecars go: below the shared folder of the cluster; on one machine without one, a folder of this process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return f"{base.rstrip('/')}/zone-index"
    if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "local")):
        raise ConfigError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not hasattr(_index_folder, "own"):
        _index_folder.own = tempfile.mkdtemp(prefix="zone-index-")
        atexit.register(shutil.rmtree, _index_folder.own, ignore_errors=True)
    return _index_folder.own


def _files(spark: SparkSession, sf_dir: str, name: str) -> list[str]:
    return data_files(spark, _uri(sf_dir, name))


def zone_table(spark: SparkSession, sf_dir: str, name: str) -> ZoneTable:
    table = ZoneTable(spark, _files(spark, sf_dir, name), INDEXED.get(name, []), _index_folder(spark))
    table.index()
    return table


def session(spark: SparkSession, sf_dir: str) -> ZoneSession:
    tables = {n: _files(spark, sf_dir, n) for n in TABLES}
    return ZoneSession.from_snapshots(spark, FileListResolver(tables), FixedIndex(by_table=INDEXED), _index_folder(spark))


def _front(sql: str) -> Query:
    """A statement through the SQL front: names, row limit, pruning."""
    return lambda spark, sf_dir: session(spark, sf_dir).run(sql).df


def _plain(sql: str) -> Query:
    """A statement over temporary views of the tables."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for n in TABLES:
            spark.read.parquet(_uri(sf_dir, n)).createOrReplaceTempView(n)
        return spark.sql(sql)

    return run


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point lookup in the events table through its zone index."""
    return zone_table(spark, sf_dir, "events").scan([("event_id", "=", 500)], ["event_id", "user_id", "event_type"])


# -- the index and its scans ---------------------------------------------------------------------------


def index_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the index says of the events table, over all zones."""
    zones = zone_table(spark, sf_dir, "events").zone_stats()
    return zones.groupBy("field_id").agg(F.sum("row_count").alias("row_count"), F.sum("null_count").alias("null_count"), F.sum("value_count").alias("value_count"))


def exact_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lookup through the source that reads listed row groups only."""
    return zone_table(spark, sf_dir, "events").scan([("user_id", "=", 7)], ["event_id", "user_id", "value"], exact=True)


def memory_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of in-memory zones: four ranges of events, whose bounds one aggregation gives."""
    from ..sources.memory import MemoryZoneTable
    from ..sources.values import Value
    from ..sources.zonemap import ColumnStats, Zone, ZoneMap

    events = spark.read.parquet(_uri(sf_dir, "events")).select("event_id", "user_id")
    bounds = events.agg(F.min("event_id").alias("lo"), F.max("event_id").alias("hi")).first()
    step = (bounds["hi"] - bounds["lo"]) // 4 + 1
    part = F.floor((F.col("event_id") - bounds["lo"]) / step)
    stats = events.groupBy(part.alias("k")).agg(F.min("event_id").alias("lo"), F.max("event_id").alias("hi"), F.count("event_id").alias("n"))
    frames, zones, at = [], [], 0
    for r in stats.where("k IS NOT NULL").orderBy("k").collect():  # a row for each zone
        lo = bounds["lo"] + r["k"] * step
        frames.append(events.where((F.col("event_id") >= lo) & (F.col("event_id") < lo + step)))
        zones.append(Zone(len(zones), at, r["n"], {1: ColumnStats(1, Value("int", r["lo"]), Value("int", r["hi"]), 0, r["n"])}))
        at += r["n"]
    table = MemoryZoneTable(spark, ZoneMap(zones), frames, {"event_id": 1}, {1: "long"})
    return table.scan([("event_id", ">=", bounds["lo"] + 3 * step)], ["event_id", "user_id"])


def snapshot_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot of several files, of which the filter's bounds leave one."""
    folder = f"{_index_folder(spark)}/snapshot-{uuid.uuid4().hex}"
    events = spark.read.parquet(_uri(sf_dir, "events"))
    events.repartitionByRange(4, "event_id").sortWithinPartitions("event_id").write.parquet(folder)
    table = snapshot_table(spark, ResolvedSnapshot(data_files(spark, folder)), INDEXED["events"], f"{folder}-index")
    top = events.agg(F.max("event_id").alias("m")).first()["m"]
    return table.scan([("event_id", ">=", top - top // 10)], ["event_id", "user_id", "event_type"])


def contract_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement recorded and run again from its record."""
    s = session(spark, sf_dir)
    return s.run_contract(s.sql_to_contract("SELECT event_id, value FROM main.default.events WHERE event_id BETWEEN 100 AND 140 ORDER BY event_id")).df


def contract_replay_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement over all events recorded and run again from its record."""
    s = session(spark, sf_dir)
    return s.run_contract(s.sql_to_contract("SELECT event_type, count(*) AS n, max(event_id) AS top FROM main.default.events GROUP BY event_type ORDER BY event_type")).df


def _ranged(spark: SparkSession, sf_dir: str, what: str, *columns: Column | str) -> ZoneTable:
    """Events in eight files of equal ranges of event_id, each one zone, with columns made from them, indexed."""
    folder = f"{_index_folder(spark)}/{what}-{uuid.uuid4().hex}"
    events = spark.read.parquet(_uri(sf_dir, "events"))
    ends = events.agg(F.min("event_id").alias("lo"), F.max("event_id").alias("hi")).first()
    step = (ends["hi"] - ends["lo"]) // 8 + 1
    part = F.floor((F.col("event_id") - ends["lo"]) / step)
    events.withColumn("part", part).select("part", *columns).repartitionById(8, F.col("part").cast("int")).sortWithinPartitions("event_id").write.parquet(folder)
    fields = [IndexField("event_id", 1, True), IndexField("user_id", 2, True), IndexField("value", 3), IndexField("ts", 4)]
    return snapshot_table(spark, ResolvedSnapshot(data_files(spark, folder)), fields, f"{folder}-index")


def zone_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of eight zones each predicate leaves, by bounds alone."""
    table = _ranged(spark, sf_dir, "survivors", "event_id", "user_id", "value", "ts")
    top = spark.read.parquet(_uri(sf_dir, "events")).agg(F.max("event_id").alias("m")).first()["m"]
    cases = {"equal": [("event_id", "=", top)], "less": [("event_id", "<", top // 3)], "greater": [("event_id", ">", top // 2)], "between": [("event_id", ">=", top // 4), ("event_id", "<=", top // 2)], "never": [("event_id", "<", -1)], "in": [("event_id", "IN", [0, top])]}
    types = table.types()
    kept = [(name, len(table.survivors(python_predicates(filters, {n: i for n, (i, _) in types.items()}, dict(types.values()))))) for name, filters in cases.items()]
    return spark.createDataFrame(kept, "name string, zones long")


def null_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column without values in the zones of the lower half: none of them can hold a match, the rest is read."""
    value = F.when(F.col("part") >= 4, F.abs("value") + 1).alias("value")
    table = _ranged(spark, sf_dir, "nulls", "event_id", "user_id", value, "ts")
    rows = table.scan([("value", ">", 0.0)], ["event_id", "value"])
    zones = sum(bool(z) for z in table.last_scan.values())
    return rows.agg(F.count("*").alias("n"), F.min("event_id").alias("first")).withColumn("zones", F.lit(zones).cast("long"))


def front_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement whose surviving row groups are read one by one, as few of them survive."""
    table = _ranged(spark, sf_dir, "exact", "event_id", "user_id", "value", "ts")
    front = ZoneSession.from_snapshots(spark, FileListResolver({"e": table.uris}), FixedIndex(table.fields), table.folder, SessionConfig(exact_below=0.9, default_limit=1_000_000))
    return front.run("SELECT event_id, user_id FROM e WHERE event_id >= 10 AND event_id < 300").df


def rezoned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events rewritten for the native reader (sorted, inline filters), and looked up there."""
    folder = f"{_index_folder(spark)}/rezoned-{uuid.uuid4().hex}"
    events = spark.read.parquet(_uri(sf_dir, "events"))
    rezone(events, folder, ["event_id"], {"user_id": events.select("user_id").distinct().count()}, files=2)
    return spark.read.parquet(folder).where("user_id = 7 OR event_id < 40").groupBy("user_id").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


def result_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column names and types of a statement that returns no row, its row count, and the tables it resolved."""
    s = session(spark, sf_dir)
    out = s.run("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey < 0")
    rows = [(f"column {k}", c.name) for k, c in enumerate(out.columns)] + [("rows", str(out.row_count()))] + [("table", t) for t in s.table_names()]
    return spark.createDataFrame(rows, "what string, name string")


def user_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vectorised function of the caller's, registered and called in a statement over all events."""
    register(spark, {"doubled": F.pandas_udf(lambda s: s * 2, "long")})
    return session(spark, sf_dir).run("SELECT event_type, sum(doubled(user_id)) AS total FROM events GROUP BY event_type").df


def synthetic_rows(spark: SparkSession, sf_dir: str) -> DataFrame:  # noqa: ARG001
    """The made-up events table, written and read again."""
    folder = f"{_index_folder(spark)}/synthetic-{uuid.uuid4().hex}"
    uris = synthetic.write_files(spark, folder, 5_000, 2, 1_000)
    return spark.read.parquet(*uris).select("id", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)").alias("micros"), "user_id", "event_id", F.col("amount").cast("string").alias("amount"))


# -- functions -----------------------------------------------------------------------------------------


def json_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(_uri(sf_dir, "events"))
    return events.select("event_id", get_json_object("props", "$.k").alias("k"), get_json_object("props", '$["k"]').alias("quoted"), get_json_object("props", "$.missing").alias("missing"))


def approx_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate counts of a column by a group, with the exact ones: how many groups there are, and how many are within a tenth."""
    events = spark.read.parquet(_uri(sf_dir, "events"))
    both = events.groupBy("event_type").agg(approx_count_distinct("user_id").alias("a"), F.countDistinct("user_id").alias("users"))
    return both.select("event_type", "users", (F.abs(F.col("a") - F.col("users")) <= 0.1 * F.col("users")).alias("close"))


# name: SQL of both engines, through the front (names, limit and pruning apply)
FRONT = {
    "point": "SELECT event_id, user_id, event_type FROM events WHERE event_id = 5000",
    "point_absent": "SELECT event_id, user_id FROM events WHERE event_id = -5",
    "flip": "SELECT event_id FROM events WHERE 20 > event_id",
    "in_list": "SELECT event_id, user_id FROM events WHERE event_id IN (3, 77, 900, 123456789)",
    "and_split": "SELECT event_id FROM events WHERE event_id >= 100 AND event_type <> 'zzz' AND event_id < 130",
    "between": "SELECT event_id FROM events WHERE event_id BETWEEN 40 AND 60",
    "not_equal": "SELECT count(*) AS n FROM events WHERE event_id <> 10",
    "either": "SELECT count(*) AS n FROM events WHERE event_id = 10 OR user_id = 3",
    "range_ts": "SELECT count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00'",
    "bloom_point": "SELECT count(*) AS n FROM events WHERE user_id = 7",
    "low_cardinality": "SELECT event_type, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY event_type",
    "decimal_filter": "SELECT count(*) AS n FROM events WHERE CAST(value AS DECIMAL(12,2)) > 50.00",
    "double_filter": "SELECT count(*) AS n FROM events WHERE value > 90",
    "is_null": "SELECT count(*) AS n FROM events WHERE value IS NULL",
    "zone_self_join": "SELECT a.event_id AS x, b.event_id AS y FROM events a FULL JOIN events b ON a.event_id = b.event_id AND a.event_id = 500 AND b.event_id = 500 WHERE a.event_id = 500 OR b.event_id = 700",
    "zone_join": "SELECT o.o_orderkey, count(*) AS n, sum(l.l_quantity) AS quantity FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey WHERE o.o_orderkey BETWEEN 100 AND 160 GROUP BY o.o_orderkey",
    "zone_join_whole": "SELECT count(DISTINCT o.o_orderkey) AS orders, count(*) AS n, sum(l.l_quantity) AS quantity FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey",
    "zone_cte_whole": "WITH e AS (SELECT user_id, count(*) AS n, max(event_id) AS top FROM events GROUP BY user_id) SELECT count(*) AS users, max(n) AS most, max(top) AS top FROM e",
    "zone_cte": "WITH e AS (SELECT event_id, value FROM events WHERE event_id < 200) SELECT count(*) AS n, max(event_id) AS top FROM e WHERE event_id >= 150",
}
# name: SQL of both engines over plain views; windows without PARTITION BY are the feature, on small tables
PLAIN = {
    "join_inner": "SELECT n.n_name, count(*) AS n FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name",
    "join_using": "SELECT count(*) AS n FROM (SELECT o_custkey AS k FROM orders) o JOIN (SELECT c_custkey AS k FROM customer) c USING (k)",
    "join_natural": "SELECT count(*) AS n FROM (SELECT n_regionkey AS r_regionkey FROM nation) a NATURAL JOIN region b",
    "join_left": "SELECT c.c_custkey, count(o.o_orderkey) AS n FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 200000 GROUP BY c.c_custkey",
    "join_right": "SELECT count(*) AS n, count(o.o_orderkey) AS matched FROM orders o RIGHT JOIN customer c ON c.c_custkey = o.o_custkey",
    "join_full": "SELECT count(*) AS n, count(s.s_suppkey) AS a, count(c.c_custkey) AS b FROM supplier s FULL JOIN customer c ON s.s_suppkey = c.c_custkey",
    "join_null_safe": "SELECT count(*) AS n FROM (SELECT CASE WHEN n_regionkey = 1 THEN NULL ELSE n_regionkey END AS k FROM nation) a JOIN (SELECT CASE WHEN r_regionkey = 1 THEN NULL ELSE r_regionkey END AS k FROM region) b ON a.k IS NOT DISTINCT FROM b.k",
    "join_lateral": "SELECT r.r_name, t.n_name FROM region r, LATERAL (SELECT n.n_name FROM nation n WHERE n.n_regionkey = r.r_regionkey ORDER BY n.n_name LIMIT 2) t",
    "join_semi": "SELECT count(*) AS n FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 100000)",
    "join_semi_in": "SELECT count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000)",
    "join_anti": "SELECT count(*) AS n FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)",
    "join_theta": "SELECT count(*) AS n FROM supplier a JOIN supplier b ON a.s_acctbal < b.s_acctbal",
    "join_cross": "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n",
    "join_range": "SELECT count(*) AS n FROM nation a JOIN nation b ON b.n_nationkey BETWEEN a.n_nationkey AND a.n_nationkey + 3",
    "agg_basic": "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity, round(avg(l_discount), 6) AS discount, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "agg_having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12",
    "agg_distinct": "SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY o_orderpriority",
    "distinct": "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem",
    "agg_filter": "SELECT count(*) FILTER (WHERE o_totalprice > 100000) AS big, count(*) AS n FROM orders",
    "grouping_sets": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())",
    "cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "rollup": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "window_rank": "SELECT c_custkey, row_number() OVER w AS rn, rank() OVER w AS r, dense_rank() OVER w AS d, ntile(4) OVER w AS q FROM customer WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_nationkey, c_custkey)",
    "window_percent": "SELECT s_suppkey, round(percent_rank() OVER (ORDER BY s_suppkey), 9) AS p, round(cume_dist() OVER (ORDER BY s_suppkey), 9) AS c FROM supplier",
    "window_analytic": "SELECT o_orderkey, lag(o_orderkey) OVER w AS before, lead(o_orderkey, 2) OVER w AS after, first_value(o_orderkey) OVER w AS first, nth_value(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)",
    "window_rows": "SELECT event_id, sum(user_id) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS s FROM events",
    "window_range": "SELECT n_nationkey, count(*) OVER (ORDER BY n_nationkey RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS n FROM nation",
    "sort_nulls": "SELECT k, row_number() OVER (ORDER BY k ASC NULLS LAST) AS rn FROM (SELECT DISTINCT CASE WHEN n_regionkey = 2 THEN NULL ELSE n_regionkey END AS k FROM nation) t",
    "top_k": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 10",
    "limit_offset": "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 7 OFFSET 11",
    "union_all": "SELECT n_name AS name FROM nation UNION ALL SELECT r_name AS name FROM region",
    "union_distinct": "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey AS k FROM region",
    "intersect": "SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0",
    "intersect_all": "SELECT n_regionkey AS k FROM nation INTERSECT ALL SELECT r_regionkey AS k FROM region",
    "except": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey AS k FROM orders WHERE o_totalprice > 150000",
    "except_all": "SELECT n_regionkey AS k FROM nation EXCEPT ALL SELECT r_regionkey AS k FROM region",
    "cte": "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey), top AS (SELECT max(total) AS m FROM big) SELECT o_custkey FROM big JOIN top ON total = m",
    "scalar_subquery": "SELECT count(*) AS n FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)",
    "correlated_subquery": "SELECT c_custkey, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS n FROM customer c",
    "values": "SELECT a, b FROM (VALUES (1, 'x'), (2, 'y')) AS t(a, b)",
    "no_table": "SELECT 1 + 1 AS two, 'a' AS letter",
    "compare": "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'high' WHEN o_totalprice > 50000 THEN 'mid' ELSE 'low' END AS class, coalesce(nullif(o_orderstatus, 'F'), 'done') AS status, o_orderkey % 7 = 0 AND NOT o_orderkey < 10 AS flag, CAST(floor(o_totalprice) AS BIGINT) AS whole FROM orders WHERE o_totalprice = floor(o_totalprice) OR o_orderkey < 500",
    "strings": "SELECT c_custkey, upper(c_name) AS u, lower(c_mktsegment) AS l, trim(concat('  ', c_name, ' ')) AS t, substring(c_name, 2, 4) AS s, length(c_name) AS n, replace(c_name, 'C', 'K') AS r, lpad(CAST(c_custkey AS STRING), 8, '0') AS p, c_name LIKE '%9' AS ends, regexp_replace(c_name, '[0-9]+', '#') AS masked FROM customer",
    "maths": "SELECT s_suppkey, abs(s_acctbal) AS a, round(s_acctbal, 1) AS r, CAST(floor(s_acctbal) AS BIGINT) AS f, CAST(ceil(s_acctbal) AS BIGINT) AS c, round(sqrt(abs(s_acctbal)), 6) AS q, round(power(s_suppkey, 2), 3) AS p, round(ln(s_suppkey), 9) AS l, round(exp(s_suppkey / 1000.0), 9) AS e, greatest(s_suppkey, 5) AS g, least(s_suppkey, 5) AS m FROM supplier WHERE s_suppkey > 0",
    "dates": "SELECT o_orderkey, date_trunc('month', o_orderdate) AS month, CAST(o_orderdate AS DATE) AS day, CAST(extract(year FROM o_orderdate) AS INT) AS y, CAST(extract(dow FROM o_orderdate) AS INT) >= 0 AS ok FROM orders",
}
# name: (Spark SQL, DuckDB SQL) where the two spell a thing differently
TWO = {
    "json_front": ("SELECT event_id, get_json_object(props, '$[\"k\"]') AS k FROM main.default.events WHERE event_id < 50", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE event_id < 50"),
    "json_front_whole": ("SELECT count(*) AS n, count(k) AS found, count(DISTINCT k) AS kinds, min(k) AS low, max(k) AS high FROM (SELECT get_json_object(props, '$[\"k\"]') AS k FROM main.default.events) t", "SELECT count(*) AS n, count(k) AS found, count(DISTINCT k) AS kinds, min(k) AS low, max(k) AS high FROM (SELECT json_extract_string(props, '$.k') AS k FROM events) t"),
    "auto_limit": ("SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 100"),
    "auto_limit_whole": ("SELECT event_id FROM events ORDER BY event_id", "SELECT event_id FROM events ORDER BY event_id LIMIT 100"),
    "fqn_whole": ("SELECT count(*) AS n, count(DISTINCT events.user_id) AS users, max(e.event_id) AS top FROM main.default.events AS e JOIN a.b.events ON e.event_id = events.event_id", "SELECT count(*) AS n, count(DISTINCT user_id) AS users, max(event_id) AS top FROM events"),
    "json_column_path": ("SELECT count(*) AS n, count(k) AS found, count(DISTINCT k) AS kinds, min(k) AS low, max(k) AS high FROM (SELECT get_json_object(props, concat('$[ \"', substring('kx', 1, 1), '\" ]')) AS k FROM main.default.events) t", "SELECT count(*) AS n, count(k) AS found, count(DISTINCT k) AS kinds, min(k) AS low, max(k) AS high FROM (SELECT json_extract_string(props, '$.k') AS k FROM events) t"),
    "arrow_cast": ("SELECT count(*) AS n, sum(arrow_cast(user_id, 'Decimal128(20, 2)')) AS total, min(arrow_cast(event_id, 'Utf8')) AS least FROM events WHERE ts >= arrow_cast(1705276800000000, 'Timestamp(Microsecond, None)')", "SELECT count(*) AS n, sum(user_id::DECIMAL(20,2)) AS total, min(event_id::VARCHAR) AS least FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00'"),
    "approx_front": ("SELECT event_type, count(DISTINCT user_id) AS users, abs(approx_distinct(user_id) - count(DISTINCT user_id)) <= 0.1 * count(DISTINCT user_id) AS close FROM cat.sch.events GROUP BY event_type", "SELECT event_type, count(DISTINCT user_id) AS users, true AS close FROM events GROUP BY event_type"),
    "fqn": ("SELECT e.event_id, events.user_id FROM main.default.events AS e JOIN a.b.events ON e.event_id = events.event_id WHERE e.event_id < 25", "SELECT event_id, user_id FROM events WHERE event_id < 25"),
}
TWO_PLAIN = {
    "arrays": ("SELECT n_regionkey, size(collect_list(n_nationkey)) AS n, array_contains(collect_list(n_nationkey), 5) AS five, element_at(array_sort(collect_list(n_nationkey)), 1) AS least FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, len(list(n_nationkey))::INT AS n, list_contains(list(n_nationkey), 5) AS five, list_sort(list(n_nationkey))[1] AS least FROM nation GROUP BY n_regionkey"),
    "array_transform": ("SELECT n_nationkey, aggregate(transform(sequence(1, 4), x -> x * n_nationkey), 0, (a, x) -> a + x) AS s FROM nation", "SELECT n_nationkey, CAST(list_sum(list_transform(range(1, 5), lambda x: x * n_nationkey)) AS INT) AS s FROM nation"),
    "explode": ("SELECT n_name, w FROM nation LATERAL VIEW explode(split(n_name, '[AEIOU]')) t AS w", "SELECT n_name, unnest(regexp_split_to_array(n_name, '[AEIOU]')) AS w FROM nation"),
    "maps_structs": ("SELECT n_nationkey, map('k', n_name)['k'] AS by_key, named_struct('a', n_nationkey, 'b', n_name).b AS by_field FROM nation", "SELECT n_nationkey, n_name AS by_key, {'a': n_nationkey, 'b': n_name}.b AS by_field FROM nation"),
    "date_math": ("SELECT o_orderkey, CAST(date_add(CAST(o_orderdate AS DATE), 30) AS DATE) AS later, datediff(DATE '1999-01-01', CAST(o_orderdate AS DATE)) AS days, date_format(o_orderdate, 'yyyy-MM') AS ym FROM orders", "SELECT o_orderkey, (CAST(o_orderdate AS DATE) + 30)::DATE AS later, datediff('day', CAST(o_orderdate AS DATE), DATE '1999-01-01')::INT AS days, strftime(o_orderdate, '%Y-%m') AS ym FROM orders"),
    "string_agg": ("SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
    "view": ("SELECT region, n FROM by_region", "SELECT n_regionkey AS region, count(*) AS n FROM nation GROUP BY n_regionkey"),
    "statistics": ("SELECT round(stddev_samp(s_acctbal), 4) AS s, round(var_pop(s_acctbal), 2) AS v, round(corr(s_acctbal, s_suppkey), 6) AS c, percentile(s_acctbal, 0.5) AS median FROM supplier", "SELECT round(stddev_samp(s_acctbal), 4) AS s, round(var_pop(s_acctbal), 2) AS v, round(corr(s_acctbal, s_suppkey), 6) AS c, quantile_cont(s_acctbal, 0.5) AS median FROM supplier"),
}


def _view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query over a view that is itself a query."""
    spark.read.parquet(_uri(sf_dir, "nation")).groupBy(F.col("n_regionkey").alias("region")).agg(F.count("*").alias("n")).createOrReplaceTempView("by_region")
    return spark.sql(TWO_PLAIN["view"][0])


def broadcast_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join that sends the smaller table, of fixed size, to all executors."""
    c, n = (spark.read.parquet(_uri(sf_dir, t)) for t in ("customer", "nation"))
    return c.join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"]).groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


def union_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files of one schema as one table."""
    folder = f"{_index_folder(spark)}/union-{uuid.uuid4().hex}"
    for name, part in (("low", "c_nationkey < 12"), ("high", "c_nationkey >= 12 OR c_nationkey IS NULL")):
        spark.read.parquet(_uri(sf_dir, "customer")).where(part).write.parquet(f"{folder}/{name}")
    table = ZoneTable(spark, [f for name in ("low", "high") for f in data_files(spark, f"{folder}/{name}")])
    return table.frame().groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.sum("c_custkey").alias("keys"))


_SURVIVORS = """
WITH b AS (SELECT min(event_id) AS lo, max(event_id) AS hi FROM events),
z AS (SELECT (event_id - lo) // ((hi - lo) // 8 + 1) AS k, min(event_id) AS a, max(event_id) AS b, max(hi) AS top FROM events, b GROUP BY 1)
SELECT name, count(*) FILTER (WHERE kept) AS zones FROM (
  SELECT 'equal' AS name, top BETWEEN a AND b AS kept FROM z UNION ALL SELECT 'less', a < top // 3 FROM z UNION ALL SELECT 'greater', b > top // 2 FROM z
  UNION ALL SELECT 'between', b >= top // 4 AND a <= top // 2 FROM z UNION ALL SELECT 'never', a < -1 FROM z UNION ALL SELECT 'in', 0 BETWEEN a AND b OR top BETWEEN a AND b FROM z) GROUP BY name"""
_SYNTHETIC = f"""
WITH a AS (SELECT r, (r::UHUGEINT + {0x9E3779B97F4A7C15}::UHUGEINT) % {1 << 64}::UHUGEINT AS z FROM range(5000) t(r)),
b AS (SELECT r, xor(z, z >> 30) * {0xBF58476D1CE4E5B9}::UHUGEINT % {1 << 64}::UHUGEINT AS z FROM a),
c AS (SELECT r, xor(z, z >> 27) * {0x94D049BB133111EB}::UHUGEINT % {1 << 64}::UHUGEINT AS z FROM b),
h AS (SELECT r, xor(z, z >> 31) AS h FROM c)
SELECT r AS id, {synthetic.TS_BASE} + r * {synthetic.TS_STEP} AS micros, (h % {synthetic.USERS})::BIGINT AS user_id, 'evt-' || lpad(lower(printf('%x', h::UBIGINT)), 16, '0') AS event_id, ((h % {synthetic.AMOUNTS})::BIGINT // 100)::VARCHAR || '.' || lpad(((h % 100)::BIGINT)::VARCHAR, 2, '0') AS amount FROM h"""

OWN: dict[str, tuple[Query, str]] = {
    "flagship": (flagship, "SELECT event_id, user_id, event_type FROM events WHERE event_id = 500"),
    "index_zones": (index_zones, "SELECT f::INT AS field_id, n::BIGINT AS row_count, (n - c)::BIGINT AS null_count, c::BIGINT AS value_count FROM (SELECT count(*) AS n, count(event_id) AS c1, count(ts) AS c2, count(user_id) AS c3, count(event_type) AS c4, count(value) AS c5 FROM events) t, LATERAL (VALUES (1, c1), (2, c2), (3, c3), (4, c4), (5, c5)) v(f, c)"),
    "exact_groups": (exact_groups, "SELECT event_id, user_id, value FROM events WHERE user_id = 7"),
    "memory_zones": (memory_zones, "SELECT event_id, user_id FROM events, (SELECT min(event_id) AS lo, max(event_id) AS hi FROM events) b WHERE event_id >= lo + 3 * ((hi - lo) // 4 + 1)"),
    "zone_survivors": (zone_survivors, _SURVIVORS),
    "null_zones": (null_zones, "SELECT count(*) AS n, min(event_id) AS first, 4::BIGINT AS zones FROM events, (SELECT min(event_id) AS lo, max(event_id) AS hi FROM events) b WHERE (event_id - lo) // ((hi - lo) // 8 + 1) >= 4 AND value IS NOT NULL"),
    "front_exact": (front_exact, "SELECT event_id, user_id FROM events WHERE event_id >= 10 AND event_id < 300"),
    "rezoned": (rezoned, "SELECT user_id, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events WHERE user_id = 7 OR event_id < 40 GROUP BY user_id"),
    "result_columns": (result_columns, "SELECT 'column ' || (row_number() OVER () - 1) AS what, column_name AS name FROM (DESCRIBE SELECT o_orderkey, o_orderstatus FROM orders) UNION ALL SELECT 'rows', count(*)::VARCHAR FROM orders WHERE o_orderkey < 0 UNION ALL SELECT 'table', 'main.default.orders'"),
    "user_function": (user_function, "SELECT event_type, CAST(sum(2 * user_id) AS BIGINT) AS total FROM events GROUP BY event_type"),
    "synthetic_rows": (synthetic_rows, _SYNTHETIC),
    "contract_replay": (contract_replay, "SELECT event_id, value FROM events WHERE event_id BETWEEN 100 AND 140"),
    "contract_replay_whole": (contract_replay_whole, "SELECT event_type, count(*) AS n, max(event_id) AS top FROM events GROUP BY event_type"),
    "json_paths": (json_paths, "SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.k') AS quoted, CAST(NULL AS VARCHAR) AS missing FROM events"),
    "approx_distinct": (approx_distinct, "SELECT event_type, count(DISTINCT user_id) AS users, true AS close FROM events GROUP BY event_type"),
    "snapshot_files": (snapshot_files, "SELECT event_id, user_id, event_type FROM events, (SELECT max(event_id) AS top FROM events) t WHERE event_id >= top - top // 10"),
    "union_files": (union_files, "SELECT c_mktsegment, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys FROM customer GROUP BY c_mktsegment"),
    "join_broadcast": (broadcast_join, "SELECT n_name, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"),
    "view": (_view, TWO_PLAIN["view"][1]),
}


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {k: f for k, (f, _) in OWN.items()}
    out |= {k: _front(s) for k, s in FRONT.items()} | {k: _front(a) for k, (a, _) in TWO.items()}
    out |= {k: _plain(s) for k, s in PLAIN.items()} | {k: _plain(a) for k, (a, _) in TWO_PLAIN.items() if k not in OWN}
    return out


def oracle_sql() -> dict[str, str]:
    out = {k: s for k, (_, s) in OWN.items()} | dict(FRONT) | dict(PLAIN)
    return out | {k: b for k, (_, b) in TWO.items()} | {k: b for k, (_, b) in TWO_PLAIN.items()}
