"""Headline measurements: prints one JSON line.

Queries run over $BENCH_SF_DIR on local[$BENCH_CPUS].  ``pruning`` repeats the spectrum of point and range
lookups over a synthetic table of $BENCH_ROWS rows in 100 row groups: groups and bytes that the index
keeps, with bounds alone and with Bloom filters, and seconds with and without pruning.
"""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time
from decimal import Decimal
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))
os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parent}:{os.environ.get('PYTHONPATH', '')}"

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
ROWS = int(os.environ.get("BENCH_ROWS", "10000000"))
HEADLINE = ["flagship", "point", "bloom_point", "range_ts", "in_list", "zone_join", "join_inner", "join_left", "join_semi", "agg_basic", "agg_distinct", "cube", "window_rank", "window_analytic", "top_k", "union_distinct", "correlated_subquery", "json_paths", "approx_distinct", "contract_replay"]


def timed(action) -> float:  # noqa: ANN001
    t = time.perf_counter()
    action()
    return round(time.perf_counter() - t, 4)


def spectrum(spark, folder: str) -> dict:  # noqa: ANN001
    from zonelight.operators.prune import surviving_zones
    from zonelight.operators.scan import ZoneTable, python_predicates
    from zonelight.sources import synthetic
    from zonelight.sources.files import footer

    uris: list[str] = []
    out: dict = {"rows": ROWS, "generate_sec": timed(lambda: uris.extend(synthetic.write_files(spark, f"{folder}/events", ROWS, 10, ROWS // 100)))}
    table = ZoneTable(spark, uris, synthetic.INDEX, f"{folder}/index")
    out["build_sec"] = timed(table.index)
    plain, sides = ZoneTable(spark, uris), {u: table.sidecar(u) for u in uris}
    size = {(u, k): sum(m.row_group(k).column(c).total_compressed_size for c in range(m.num_columns)) for u in uris for m in [footer(u)] for k in range(m.num_row_groups)}
    out["groups"], out["bytes"] = len(size), sum(size.values())
    import datetime as dt

    p90 = dt.datetime.fromtimestamp((synthetic.TS_BASE + ROWS * 9 // 10 * synthetic.TS_STEP) / 1e6, dt.timezone.utc).replace(tzinfo=None)
    some = synthetic.event_name(ROWS // 3)
    cases = {"id = mid": [("id", "=", ROWS // 2)], "ts >= p90": [("ts", ">=", p90)], "user_id = X": [("user_id", "=", synthetic.user_of(ROWS // 3))], "event_id = existing": [("event_id", "=", some)], "event_id = absent": [("event_id", "=", some + "z")], "amount > 99000": [("amount", ">", Decimal("99000.00"))], "region = eu": [("region", "=", "eu")]}
    out["cases"] = {}
    for name, filters in cases.items():
        side = sides[uris[0]]
        predicates = python_predicates(filters, side.field_ids, side.types)
        kept = {b: {(u, sides[u].zone_map.zones[i].zone_id) for u in uris for i in surviving_zones(sides[u].zone_map, sides[u].blooms if b else None, predicates)} for b in (False, True)}
        exact = len(kept[True]) < len(kept[False]) // 4  # where only the filters tell row groups apart
        count = lambda t, e=False, f=filters: t.scan(f, ["id"], exact=e).count()
        rows = count(table, exact)
        if rows != count(plain):
            raise AssertionError(name)
        out["cases"][name] = {"groups_bounds": len(kept[False]), "groups_indexed": len(kept[True]), "bytes_indexed": sum(size[k] for k in kept[True]), "rows": rows, "indexed_sec": timed(lambda e=exact: count(table, e)), "plain_sec": timed(lambda: count(plain))}
    return out


def main() -> None:
    from pyspark.sql import SparkSession

    from zonelight.plans import catalogue

    spark = SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g").config("spark.driver.host", "127.0.0.1").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = catalogue.queries(), {}
    for name in HEADLINE:
        run = lambda q=queries[name]: q(spark, SF_DIR).write.format("noop").mode("overwrite").save()
        run()
        seconds[name] = min(timed(run) for _ in range(2))
    folder = tempfile.mkdtemp(prefix="bench-")
    try:
        pruning = spectrum(spark, folder) if ROWS else {}
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": SF_DIR.rsplit("sf", 1)[-1], "pruning": pruning}))
    spark.stop()


if __name__ == "__main__":
    main()
