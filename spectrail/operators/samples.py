"""The sample table: at most one row a run, written after the fact."""

from __future__ import annotations

import os
import shutil
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrail.errors import SemanticError, StudyError
from spectrail.functions.vocab import BY_NAME, CONSUMED, KEYS, PEAKS
from spectrail.sources import manifest as mf
from spectrail.sources.dataset import SAMPLES, Dataset


def run_data(data: Dataset) -> DataFrame:
    return data.samples()


def set_run_data(data: Dataset, table: DataFrame) -> None:
    """Replaces the sample table. run_id must be there, unique, known and not null; no column may hide a variable."""
    if "run_id" not in table.columns:
        raise SemanticError("the sample table needs run_id")
    low = {c.lower() for c in (*BY_NAME, *CONSUMED, *KEYS, *PEAKS, "dataStorage")} | {c.lower() for c in data.raw().columns}
    if bad := [c for c in table.columns if c != "run_id" and c.lower() in low]:
        raise SemanticError(f"columns would hide variables: {bad[:5]}", columns=bad)
    with mf.locked(data.path):
        manifest = mf.read(data.path)
        known = [r["run_id"] for r in manifest["runs"]]
        ids = [r.run_id for r in table.select(F.col("run_id").cast("string")).limit(len(known) + 1).collect()]
        if any(i is None for i in ids) or len(set(ids)) != len(ids):
            raise SemanticError("run_id must be unique and not null", run_ids=[i for i in ids if ids.count(i) > 1][:5])
        if unknown := [i for i in ids if i not in known]:
            raise StudyError(f"no runs {unknown[:5]}", run_ids=unknown)
        target, staging = os.path.join(data.path, SAMPLES), os.path.join(data.path, f".staging-{uuid.uuid4().hex}")
        try:
            table.withColumn("run_id", F.col("run_id").cast("string")).coalesce(1).write.parquet(f"file://{os.path.abspath(staging)}")
            part = next(f for f in os.listdir(staging) if f.endswith(".parquet"))
            os.makedirs(os.path.dirname(target), exist_ok=True)
            if os.path.isdir(target):
                shutil.rmtree(target)
            os.replace(os.path.join(staging, part), target)  # one file: there is always an old table or a new one
        finally:
            shutil.rmtree(staging, ignore_errors=True)
        mf.write(data.path, manifest, lock=False)
