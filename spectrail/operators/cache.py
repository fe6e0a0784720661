"""Persisted metadata of datasets, bounded in cells; keyed by path and generation, so a newer dataset is never read from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from spectrail.sources import manifest as mf
from spectrail.sources.dataset import Dataset

COLUMNS = ("msLevel", "rtime", "precursorMz")
MAX_CELLS = 50_000_000

_held: dict[tuple, DataFrame] = {}


def metadata(data: Dataset, columns: Sequence[str] = COLUMNS, max_cells: int = MAX_CELLS) -> DataFrame:
    """spectrum_id_ and the columns; kept in memory if spectra x columns stay within `max_cells`, else a plain scan."""
    df = data.view().select("spectrum_id_", *columns)
    manifest = data.manifest
    if mf.n_spectra(manifest) * len(columns) > max_cells:
        return df
    key = (data.path, manifest["generation"], tuple(columns))
    for old in [k for k in _held if k[0] == data.path and k[1] != key[1]]:
        _held.pop(old).unpersist()
    if key not in _held:
        _held[key] = df.persist(StorageLevel.MEMORY_AND_DISK)
    return _held[key]


def whole(data: Dataset, max_cells: int = MAX_CELLS) -> DataFrame:
    """All variables but the lists, kept in memory under the same bound."""
    names = [c for c in data.view().columns if c not in (*data.peak_variables(), "spectrum_id_")]
    return metadata(data, names, max_cells)


def warm(data: Dataset, columns: Sequence[str] = COLUMNS) -> int:
    return metadata(data, columns).count()


def invalidate(path: str | None = None) -> None:
    """Forgets what is kept of a dataset, or of all."""
    mf.forget(path)
    for key in [k for k in _held if path is None or k[0] == path]:
        df = _held.pop(key)
        df.unpersist()
        if key[0]:
            df.sparkSession.catalog.refreshByPath(key[0])
