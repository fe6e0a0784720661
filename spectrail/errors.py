"""Typed errors; `data` holds what the message is about."""

from __future__ import annotations


class SpectrailError(Exception):
    """Base of all errors of the engine."""

    kind = "error"

    def __init__(self, message: str, **data) -> None:
        super().__init__(message)
        self.data = data


class FormatError(SpectrailError):
    kind = "format"


class ArchiveError(SpectrailError):
    kind = "archive"


class ReferenceError(SpectrailError):  # noqa: A001
    kind = "reference"


class StudyError(SpectrailError):
    kind = "study"


class StaleError(SpectrailError):
    kind = "stale"


class UnsupportedError(SpectrailError):
    kind = "unsupported"


class SemanticError(SpectrailError):
    kind = "semantic"


class CapabilityError(SpectrailError):
    kind = "capability"


class ResourceError(SpectrailError):
    kind = "resource"


class ConflictError(SpectrailError):
    kind = "conflict"


class ReadOnlyError(UnsupportedError):
    """An attempt to replace what a dataset fixes: ids, names, peaks."""


KINDS = {c.kind: c for c in (FormatError, ArchiveError, ReferenceError, StudyError, StaleError, UnsupportedError, SemanticError, CapabilityError, ResourceError, ConflictError)}
