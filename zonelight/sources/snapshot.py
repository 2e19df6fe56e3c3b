"""Tables over several files."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..errors import ConfigError
from ..operators.build import IndexField
from ..operators.scan import ZoneTable
from .files import S3Config
from .resolvers import ResolvedSnapshot


def snapshot_table(spark: SparkSession, snapshot: ResolvedSnapshot, fields: list[IndexField], folder: str | None = None) -> ZoneTable:
    """The union of a snapshot's files, each with its own sidecar; the first file's schema holds for all."""
    if not snapshot.files:
        raise ConfigError("a snapshot without files has no schema")
    table = ZoneTable(spark, snapshot.files, fields, folder, snapshot.store)
    table.index()
    return table


def parquet_table(spark: SparkSession, uri: str, fields: list[IndexField], folder: str | None = None, store: S3Config | None = None) -> ZoneTable:
    """One file, indexed and opened."""
    return snapshot_table(spark, ResolvedSnapshot([uri], store), fields, folder)
