"""Files behind URIs: one place that turns a URI into a file system and a path."""

from __future__ import annotations

import hashlib
import os
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import SparkSession

from ..errors import ConfigError


@dataclass(frozen=True)
class S3Config:
    """An S3-compatible store with path-style addresses."""

    endpoint: str
    access_key: str
    secret_key: str
    bucket: str = "lakehouse"
    region: str = "auto"

    @staticmethod
    def from_env(prefix: str = "LAKEHOUSE_S3_") -> S3Config:
        """Read <prefix>ENDPOINT, ACCESS_KEY, SECRET_KEY, BUCKET and REGION."""
        env = os.environ
        missing = [k for k in ("ENDPOINT", "ACCESS_KEY", "SECRET_KEY") if not env.get(prefix + k)]
        if missing:
            raise ConfigError("not set: " + ", ".join(prefix + k for k in missing))
        return S3Config(env[prefix + "ENDPOINT"], env[prefix + "ACCESS_KEY"], env[prefix + "SECRET_KEY"], env.get(prefix + "BUCKET", "lakehouse"), env.get(prefix + "REGION", "auto"))

    def spark_options(self) -> dict[str, str]:
        """Settings of a Spark session that reads s3a:// URIs of this store."""
        base = "spark.hadoop.fs.s3a."
        return {base + "endpoint": self.endpoint, base + "endpoint.region": self.region, base + "access.key": self.access_key, base + "secret.key": self.secret_key, base + "path.style.access": "true"}

    def read_options(self) -> dict[str, str]:
        """The same settings as options of one read."""
        return {k.removeprefix("spark.hadoop."): v for k, v in self.spark_options().items()}

    def filesystem(self) -> pafs.FileSystem:
        scheme, _, host = self.endpoint.rpartition("://")
        return pafs.S3FileSystem(access_key=self.access_key, secret_key=self.secret_key, endpoint_override=host, scheme=scheme or "https", region=self.region, force_virtual_addressing=False)


def normal_uri(uri: str) -> str:
    """s3:// as Spark spells it; other URIs and paths as they are."""
    return "s3a://" + uri[5:] if uri.startswith("s3://") else uri


def object_key(uri: str) -> str:
    """The key of an object URI within its bucket; other paths without a leading slash."""
    for scheme in ("s3://", "s3a://"):
        if uri.startswith(scheme):
            return uri[len(scheme) :].partition("/")[2]
    return uri.removeprefix("file://").lstrip("/")


def opened(uri: str, store: S3Config | None = None) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI or a local path."""
    if uri.startswith(("s3://", "s3a://")):
        rest = uri.partition("://")[2]
        return (store or S3Config.from_env()).filesystem(), rest
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" in uri:
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), uri


def reachable(uri: str, store: S3Config | None = None) -> bool:
    """Whether this process's own file systems reach a URI; some only Spark's do."""
    try:
        opened(uri, store)
    except (OSError, ValueError, ConfigError, pa.ArrowException):
        return False
    return True


def _hadoop(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """Spark's file system for a path, and the path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def data_files(spark: SparkSession, path: str) -> list[str]:
    """The Parquet files of a file or folder that Spark can read, in order of their names."""
    fs, at = _hadoop(spark, path)
    if not fs.getFileStatus(at).isDirectory():
        return [path]
    found = [s.getPath() for s in fs.listStatus(at) if s.isFile()]
    return sorted(p.toString() for p in found if p.getName().endswith(".parquet") and p.getName()[0] not in "._")


def version_of(spark: SparkSession, uri: str, store: S3Config | None = None) -> str:
    """The fingerprint of a file, by Spark's file system where this process's own don't reach it."""
    if reachable(uri, store):
        return fingerprint(uri, store)
    fs, at = _hadoop(spark, uri)
    status = fs.getFileStatus(at)
    return f"{status.getLen()}:{status.getModificationTime()}"


def fingerprint(uri: str, store: S3Config | None = None) -> str:
    """Path, size and time of change of a file; an index of another fingerprint is stale."""
    fs, path = opened(uri, store)
    info = fs.get_file_info(path)
    if info.type != pafs.FileType.File:
        raise FileNotFoundError(uri)
    return f"{info.size}:{info.mtime_ns}"


def footer(uri: str, store: S3Config | None = None) -> pq.FileMetaData:
    fs, path = opened(uri, store)
    with fs.open_input_file(path) as f:
        return pq.read_metadata(f)


def sidecar_name(uri: str) -> str:
    return hashlib.sha256(uri.encode()).hexdigest()[:32] + ".puffin"
