"""Errors of the engine."""

from __future__ import annotations


class ZoneError(Exception):
    """Base of all errors that the engine raises itself."""


class Truncated(ZoneError):
    """Bytes end before the layout does."""


class BadVersion(ZoneError):
    """A payload of a version that this code can't read."""


class MissingType(ZoneError):
    """A bound of a field whose type is not known."""


class BadContainer(ZoneError):
    """Bytes that are no sidecar container: magic, footer or blob bounds are wrong."""


class UnsupportedCodec(ZoneError):
    """A blob or footer compressed in a way that this code can't undo."""


class MissingColumn(ZoneError):
    """A column to index that the file doesn't have."""


class UnsupportedType(ZoneError):
    """A column type that can't be indexed."""


class ConfigError(ZoneError):
    """A table or service that is not set up as it must be."""


class TableNotFound(ZoneError):
    """A name that the resolver doesn't know, or doesn't show."""


class ReadOnly(ZoneError):
    """A statement that would change something."""
