"""Archives into a dataset: a flat index row for each spectrum; the signal stays where it is."""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrail.errors import ArchiveError, FormatError, StudyError
from spectrail.sources import manifest as mf
from spectrail.sources.archive import Archive, is_archive, leaves, resolve, rows_of, unpack
from spectrail.sources.dataset import Dataset, union_by_name

INDEX_ROW_GROUP = 4096
#: Archives whose indexes one job writes.
TOGETHER = 50
#: Index column, type, and where it may be found.
METADATA = (
    ("id", "string", "id"), ("ms_level", "int", "ms_level"), ("time", "double", "time"), ("scan_polarity", "int", "scan_polarity"),
    ("spectrum_representation", "string", "spectrum_representation"), ("spectrum_type", "string", "spectrum_type"),
    ("lowest_observed_mz", "double", "lowest_observed_mz"), ("highest_observed_mz", "double", "highest_observed_mz"),
    ("base_peak_mz", "double", "base_peak_mz"), ("base_peak_intensity", "double", "base_peak_intensity"), ("total_ion_current", "double", "total_ion_current"),
    ("number_of_peaks", "int", "number_of_peaks"), ("number_of_data_points", "int", "number_of_data_points"),
)
SCANS = (
    ("scan_index", "int", "scan_index"), ("filter_string", "string", "filter_string"), ("ion_injection_time", "double", "ion_injection_time"),
    ("instrument_configuration_id", "int", "instrument_configuration_id"), ("scan_window_lower_limit", "double", "scan_windows.scan_window_lower_limit"),
    ("scan_window_upper_limit", "double", "scan_windows.scan_window_upper_limit"),
)
IONS = (("selected_ion_mz", "double", "selected_ion_mz"), ("charge_state", "int", "charge_state"), ("peak_intensity", "double", "peak_intensity"))
PRECURSORS = (
    ("precursor_index", "int", "precursor_index"), ("isolation_window_target", "double", "isolation_window.isolation_window_target"),
    ("isolation_window_lower_offset", "double", "isolation_window.isolation_window_lower_offset"), ("isolation_window_upper_offset", "double", "isolation_window.isolation_window_upper_offset"),
    ("collision_energy", "double", "activation.collision_energy"), ("activation_type", "string", "activation.activation_type"),
)
FACETS = (("scans", SCANS, "n_scans"), ("selected_ions", IONS, "n_selected_ions"), ("precursors", PRECURSORS, "n_precursors"))


def _picked(df: DataFrame, wanted) -> list:
    found = leaves(df.schema)
    out = []
    for name, kind, path in wanted:
        c = resolve(found, path)
        if c is not None:
            out.append(c.cast(kind).alias(name))
    return out


def first_and_count(facet: DataFrame, key: str, order: str | None, columns: list, count: str) -> DataFrame:
    """A row for each key: the columns of its first row, and how many it has. One grouped pass with map-side combining."""
    at = F.col(order) if order else F.col("_row")
    rows = facet.select(F.col(key).cast("long").alias("_key"), at.alias("_at"), *([F.col("_row")] if "_row" in facet.columns else [F.lit(0).alias("_row")]), F.struct(*columns).alias("_first"))
    out = rows.groupBy("_key").agg(F.min_by("_first", F.struct("_at", "_row")).alias("_first"), F.count("*").cast("int").alias(count))
    return out.select("_key", "_first.*", count)


def index_frame(spark: SparkSession, archive: Archive, base: int, origin: str | None = None) -> DataFrame:
    """The flat index of an archive: metadata, and the first row of each facet with its count. The origin is what the manifest has as its source."""
    meta = spark.read.parquet(archive.member("spectrum", "metadata", needed=True))
    found = leaves(meta.schema)
    index = resolve(found, "index")
    if index is None:
        raise ArchiveError(f"{archive.path}: the metadata has no index", path=archive.path)
    known = {"index"} | {p for _, _, p in METADATA}
    rest = [c.alias(p) for p, c in found.items() if "." not in p and p not in known]
    out = meta.select(index.cast("long").alias("spectrum_index"), (index + F.lit(base)).cast("int").alias("spectrum_id_"), F.lit(origin or archive.path).alias("data_origin"), *_picked(meta, METADATA), *rest)
    for kind, wanted, count in FACETS:
        name = archive.facet(kind) or archive.facet(f"metadata_{kind}")
        if name is None:
            continue
        facet = spark.read.parquet(name)
        rows = facet.select("*", F.col("_metadata.row_index").alias("_row"))
        order = "scan_index" if kind == "scans" and "scan_index" in facet.columns else None
        first = first_and_count(rows, "source_index", order, _picked(facet, wanted), count)
        out = out.join(first, out["spectrum_index"] == first["_key"], "left").drop("_key")
    return out


def create_from_archives(spark: SparkSession, path: str, archives: Sequence[str], *, link: str = "reference") -> Dataset:
    if mf.is_dataset(path):
        raise FormatError(f"{path} is a dataset already", path=path)
    os.makedirs(path, exist_ok=True)
    mf.write(path, mf.new())
    return add_archives(spark, path, archives, link=link)


def add_archives(spark: SparkSession, path: str, archives: Sequence[str], *, link: str = "reference") -> Dataset:
    """Registers archives as runs behind those there are. All are checked, and their indexes written aside, before any counts."""
    if link not in ("reference", "copy"):
        raise FormatError("link must be reference or copy", link=link)
    with mf.locked(path):
        manifest = mf.read(path)
        if manifest["runs"] and mf.kind_of(manifest) != "archive":
            raise FormatError(f"{path} holds native runs", path=path)
        staging, maps, frames, runs = os.path.join(path, f".staging-{uuid.uuid4().hex}"), [], [], []
        try:
            for source in archives:
                if not is_archive(source):
                    raise ArchiveError(f"{source} is no archive", path=source)
                at = os.path.abspath(source)
                if zipfile_like := not os.path.isdir(at):
                    at = unpack(at, os.path.join(path, "runs", os.path.splitext(os.path.basename(at))[0]))
                elif link == "copy":
                    at = shutil.copytree(at, os.path.join(path, "runs", os.path.basename(os.path.normpath(at))))
                archive = Archive(spark, at)
                signal = archive.validate() | {"source": os.path.abspath(source) if zipfile_like else at}
                run = archive.run_id()
                if any(r["run_id"].lower() == run.lower() for r in manifest["runs"]):
                    raise StudyError(f"run {run!r} is in the dataset already", run_id=run)
                n = rows_of(archive.member("spectrum", "metadata", needed=True))
                frames.append(index_frame(spark, archive, mf.next_base(manifest), signal["source"]).withColumn("run_id", F.lit(run)))
                manifest = mf.add_run(manifest, run, "archive", at, n, signal)
                runs.append((run, n))
                maps += archive.column_map()
            for at in range(0, len(frames), TOGETHER):  # one job for many archives
                rows = union_by_name(frames[at : at + TOGETHER]).repartition("run_id").sortWithinPartitions("run_id", "spectrum_id_")
                rows.write.mode("append").partitionBy("run_id").option("compression", "zstd").option("parquet.block.row.count.limit", INDEX_ROW_GROUP).parquet(f"file://{os.path.abspath(staging)}")
            if runs:
                counts = {str(r.run_id): r.n for r in spark.read.schema("spectrum_id_ int, run_id string").parquet(f"file://{os.path.abspath(staging)}").groupBy("run_id").agg(F.count("*").alias("n")).collect()}
                if counts != dict(runs):
                    raise ArchiveError(f"{path}: the indexes do not have the announced numbers of spectra", announced=dict(runs), written=counts)
            os.makedirs(os.path.join(path, "index", "spectra"), exist_ok=True)
            for run, _ in runs:
                os.rename(os.path.join(staging, f"run_id={run}"), os.path.join(path, "index", "spectra", f"run_id={run}"))
        finally:
            shutil.rmtree(staging, ignore_errors=True)
        _merge_column_map(path, maps)
        mf.write(path, manifest, lock=False)
    return Dataset.open(spark, path)


def _merge_column_map(path: str, new: list[dict]) -> None:
    """Provenance of columns, the first of each (path, accession)."""
    if not new:
        return
    name = os.path.join(path, "index", "column_map.json")
    held = json.load(open(name, encoding="utf-8")) if os.path.exists(name) else []
    kept: dict[tuple, dict] = {}
    for m in [*held, *new]:
        kept.setdefault((m["path"], m["accession"]), m)
    with open(f"{name}.tmp", "w", encoding="utf-8") as f:
        json.dump(list(kept.values()), f, ensure_ascii=False, indent=1)
    os.replace(f"{name}.tmp", name)
