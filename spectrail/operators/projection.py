"""Copies of archive points in order of m/z: a search by m/z then skips most of them. Never needed for an answer."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrail.errors import ReferenceError, UnsupportedError
from spectrail.sources import manifest as mf
from spectrail.sources.archive import chosen, signal_points
from spectrail.sources.dataset import Dataset, read_runs

ROW_GROUP = 100_000
KIND = "mzsorted"


def folder(path: str) -> str:
    return os.path.join(path, "index", "projections", KIND)


def _runs(data: Dataset, runs: Sequence[str] | None) -> list[dict]:
    if data.kind != "archive":
        raise UnsupportedError("only archive datasets have projections", kind=data.kind)
    held = {r["run_id"]: r for r in data.manifest["runs"]}
    if unknown := [r for r in runs or () if r not in held]:
        raise ReferenceError(f"no runs {unknown[:5]}", run_ids=unknown)
    return [held[r] for r in (runs or held)]


def build_projection(data: Dataset, runs: Sequence[str] | None = None, kind: str = KIND) -> None:
    """Writes the sorted copies of the runs. The representation that they were made from is noted."""
    mf.check_projection(kind)
    with mf.locked(data.path):
        manifest = mf.read(data.path)
        for r in _runs(data, runs):
            target, staging = os.path.join(folder(data.path), f"run_id={r['run_id']}"), os.path.join(data.path, f".staging-{uuid.uuid4().hex}")
            points = signal_points(data.spark, r, data.representation)
            points.repartitionByRange("mz").sortWithinPartitions("mz").write.option("compression", "zstd").option("parquet.block.row.count.limit", ROW_GROUP).parquet(staging)
            shutil.rmtree(target, ignore_errors=True)
            os.makedirs(os.path.dirname(target), exist_ok=True)
            os.rename(staging, target)
            mf.set_projection(manifest, r["run_id"], kind, source=os.path.basename(chosen(r, data.representation)))
        mf.write(data.path, manifest, bump=False, lock=False)


def drop_projection(data: Dataset, runs: Sequence[str] | None = None, kind: str = KIND) -> None:
    mf.check_projection(kind)
    with mf.locked(data.path):
        manifest = mf.read(data.path)
        for r in _runs(data, runs):
            mf.drop_projection(manifest, r["run_id"], kind)
            shutil.rmtree(os.path.join(folder(data.path), f"run_id={r['run_id']}"), ignore_errors=True)
        mf.write(data.path, manifest, bump=False, lock=False)


def search_points(data: Dataset) -> DataFrame:
    """spectrum_id_, mz of all points: of the sorted copies, if every run has one of the representation asked for."""
    if data.path is None:
        return data.points()
    manifest = data.manifest
    same = all(mf.has_projection(manifest, [r["run_id"]], KIND, source=os.path.basename(chosen(r, data.representation))) for r in manifest["runs"])
    if manifest["runs"] and same:
        return read_runs(data.spark, folder(data.path)).select(F.col("spectrum_id_").cast("int"), "mz")
    return data.points().select("spectrum_id_", "mz")
