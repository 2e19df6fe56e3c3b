"""In-memory tables of zones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.prune import Predicate, surviving_zones
from ..operators.scan import python_predicates
from .bloom import ZoneBlooms
from .zonemap import ZoneMap


class MemoryZoneTable:
    """One frame for each zone; a scan reads the frames of the zones that survive, in order of the zones."""

    def __init__(self, spark: SparkSession, zone_map: ZoneMap, frames: list[DataFrame], field_ids: dict[str, int], types: dict[int, str], blooms: ZoneBlooms | None = None) -> None:
        if len(frames) != len(zone_map.zones):
            raise ValueError("one frame for each zone")
        self.spark, self.zone_map, self.frames = spark, zone_map, frames
        self.field_ids, self.types, self.blooms = field_ids, types, blooms
        self.observed: list[list[int]] = []

    def with_blooms(self, blooms: ZoneBlooms) -> MemoryZoneTable:
        self.blooms = blooms
        return self

    def surviving_zones(self, filters: list[tuple]) -> list[int]:
        return surviving_zones(self.zone_map, self.blooms, self._predicates(filters))

    def _predicates(self, filters: list[tuple]) -> list[Predicate]:
        return python_predicates(filters, self.field_ids, self.types)

    def scan(self, filters: list[tuple] = (), columns: list[str] | None = None) -> DataFrame:
        """The rows of surviving zones that meet all filters."""
        kept = self.surviving_zones(list(filters))
        self.observed.append(kept)
        out = self.frames[0].limit(0) if not kept else self.frames[kept[0]]
        for i in kept[1:]:
            out = out.unionAll(self.frames[i])
        for name, op, x in filters:
            c = F.col(name)
            out = out.where(c.isin(list(x)) if op == "IN" else {"=": c == x, "<": c < x, "<=": c <= x, ">": c > x, ">=": c >= x}[op])
        return out.select(*columns) if columns else out
