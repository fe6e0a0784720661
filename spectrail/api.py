"""What users call: making, opening and extending datasets."""

from __future__ import annotations

import os
import shutil
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from spectrail.errors import FormatError
from spectrail.operators import cache
from spectrail.operators.handle import Handle
from spectrail.operators.ingest import add_archives, create_from_archives
from spectrail.operators.projection import build_projection, drop_projection
from spectrail.operators.samples import run_data, set_run_data
from spectrail.operators.writer import ROW_GROUP, append_native, write_native
from spectrail.sources import manifest
from spectrail.sources.dataset import Dataset
from spectrail.sources.mzml import check_files, read_mzml

__all__ = [
    "Dataset", "Handle", "add_archives", "append", "build_projection", "cache", "create", "create_from_archives", "drop_projection", "from_mzml", "manifest", "open_dataset", "run_data", "set_run_data",
]


def open_dataset(spark: SparkSession, path: str, representation: str = "auto") -> Handle:
    return Dataset.open(spark, path, representation).spectra()


def create(spark: SparkSession, path: str, data: DataFrame | None = None, files: Sequence[str] | None = None, *, partitioning: Sequence[str] = (), compression: str = "snappy", row_group: int = ROW_GROUP, order_by: str | None = None) -> Dataset:
    """A new native dataset from a frame of variables and peak lists, or from mzML files in the order given."""
    if (data is None) == (files is None):
        raise FormatError("give either data or files")
    if files is not None:
        data, order_by = read_mzml(spark, files).drop("file_"), None  # a partition a file, its spectra in their order
    write_native(data, path, order_by=order_by, partitioning=partitioning, compression=compression, row_group=row_group)
    return Dataset.open(spark, path)


def append(data: Dataset, more: DataFrame | None = None, files: Sequence[str] | None = None, *, order_by: str | None = None, **how) -> Dataset:
    """Adds the spectra of a frame or of mzML files to a native dataset, as runs behind those there are."""
    if (more is None) == (files is None):
        raise FormatError("give either more or files")
    if files is not None:
        more, order_by = read_mzml(data.spark, files).drop("file_"), None
    append_native(more, data.path, order_by=order_by, **how)
    return Dataset.open(data.spark, data.path, data.representation)


def from_mzml(spark: SparkSession, files: Sequence[str], path: str, *, overwrite: bool = False, **how) -> Handle:
    """Converts mzML files and opens the result; an existing dataset is replaced only if asked for."""
    check_files(files)
    if os.path.exists(path) and os.listdir(path):
        if not overwrite or not manifest.is_dataset(path):
            raise FormatError(f"{path} is not empty", path=path)
        shutil.rmtree(path)
        cache.invalidate(path)
    return create(spark, path, files=files, **how).spectra()
