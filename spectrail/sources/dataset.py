"""A dataset: a directory of Parquet files under a manifest, or frames of the same shape held in memory."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from spectrail.errors import CapabilityError, FormatError
from spectrail.functions.vocab import KEYS, PEAKS, translate
from spectrail.sources import manifest as mf

REPRESENTATIONS = ("auto", "profile", "centroid")
SAMPLES = os.path.join("index", "samples.parquet")


def read_runs(spark: SparkSession, folder: str, string_keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """All Parquet files below a folder of run_id= directories, joined by column name.

    Directory values of `string_keys` stay text whatever they look like. Where runs wrote a column with different types,
    they are read by schema and cast to the widest.
    """
    def fixed(schema: StructType) -> StructType:
        return StructType([StructField(f.name, StringType() if f.name in string_keys else f.dataType) for f in schema.fields])

    try:
        found = spark.read.option("mergeSchema", True).parquet(folder).schema
        return spark.read.schema(fixed(found)).parquet(folder)
    except Exception as e:  # noqa: BLE001
        if "CANNOT_MERGE_SCHEMAS" not in str(e) and "Failed to merge" not in str(e) and "FAILED_MERGE" not in str(e):
            raise
    groups: dict[str, tuple[StructType, list[str]]] = {}
    for name in sorted(os.listdir(folder)):
        run = os.path.join(folder, name)
        if "=" in name and os.path.isdir(run):
            schema = fixed(spark.read.option("basePath", folder).parquet(run).schema)
            groups.setdefault(schema.json(), (schema, []))[1].append(run)
    frames = [spark.read.schema(schema).option("basePath", folder).parquet(*runs) for schema, runs in groups.values()]
    return union_by_name(frames)


RANK = {"tinyint": 0, "smallint": 1, "int": 2, "bigint": 3, "float": 4, "double": 5, "string": 6}


def _wider(a: str, b: str) -> str:
    """The narrowest type that holds both: a float can't hold what an int can."""
    if a not in RANK or b not in RANK:
        return "string"
    if {a, b} in ({"int", "float"}, {"bigint", "float"}):
        return "double"
    return max(a, b, key=RANK.get)


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames; columns by name, absent ones null, each of the widest type that a frame has for it."""
    widest: dict[str, str] = {}
    for df in frames:
        for name, kind in df.dtypes:
            old = widest.setdefault(name, kind)
            if old != kind:
                widest[name] = _wider(old, kind)
    out = None
    for df in frames:
        df = df.select(*[F.col(f"`{n}`").cast(widest[n]).alias(n) if widest[n] != k else F.col(f"`{n}`") for n, k in df.dtypes])
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


class Dataset:
    """Open with `Dataset.open`; `spectra()` is the handle of all spectra. Holds no data."""

    def __init__(self, spark: SparkSession, path: str | None, representation: str = "auto", *, raw: DataFrame | None = None, points: DataFrame | None = None, samples: DataFrame | None = None) -> None:
        if representation not in REPRESENTATIONS:
            raise CapabilityError(f"representation must be one of {REPRESENTATIONS}", representation=representation)
        self.spark, self.path, self.representation = spark, path, representation
        self._raw, self._points, self._samples = raw, points, samples
        self._read: tuple = (None, None)
        self._viewed: tuple = (None, None)

    @classmethod
    def open(cls, spark: SparkSession, path: str, representation: str = "auto") -> Dataset:
        if not mf.is_dataset(path):
            raise FormatError(f"{path} is not a dataset", path=path)
        mf.load(path)
        return cls(spark, path, representation)

    @classmethod
    def of_frames(cls, spark: SparkSession, raw: DataFrame, points: DataFrame | None = None, samples: DataFrame | None = None) -> Dataset:
        """raw: on-disk columns with spectrum_id_ and run_id, peaks as lists or, if `points` is given, in rows of spectrum_id_, mz, intensity."""
        return cls(spark, None, raw=raw, points=points, samples=samples)

    @property
    def manifest(self) -> dict:
        return mf.load(self.path)

    @property
    def kind(self) -> str:
        if self.path is None:
            return "native" if self._points is None else "archive"
        return mf.kind_of(self.manifest)

    @property
    def run_ids(self) -> list[str]:
        return [r["run_id"] for r in self.manifest["runs"]]

    def raw(self) -> DataFrame:
        """Metadata (and native peak lists) under their on-disk names, with spectrum_id_ and run_id. Files are listed, and their schemas merged, once for each state of the dataset."""
        if self._raw is not None:
            return self._raw
        stamp = mf.stamp(self.path)
        if self._read[0] != stamp:
            self._read = stamp, self._scan()
        return self._read[1]

    def _scan(self) -> DataFrame:
        if not self.manifest["runs"]:
            return self.spark.createDataFrame([], "spectrum_id_ int, run_id string, spectrum_index long" + (", mz array<double>, intensity array<double>" if self.kind == "native" else ""))
        if self.kind == "native":
            keys = {k for r in self.manifest["runs"] for k in r["signal"].get("partitioning") or []}
            return read_runs(self.spark, os.path.join(self.path, "spectra"), ("run_id", *sorted(k for k in keys if k == "dataOrigin")))
        return read_runs(self.spark, os.path.join(self.path, "index", "spectra"))

    def view(self) -> DataFrame:
        raw = self.raw()
        if self._viewed[0] is not raw:
            self._viewed = raw, translate(raw, self.path)
        return self._viewed[1]

    def points(self, run_ids: Sequence[str] | None = None) -> DataFrame:
        """spectrum_id_, mz, intensity of an archive dataset's points: one frame over all runs, read in parallel."""
        if self._points is not None:
            return self._points
        from spectrail.sources.archive import signal_points

        frames = []
        for r in self.manifest["runs"]:
            if run_ids is None or r["run_id"] in run_ids:
                frames.append(signal_points(self.spark, r, self.representation))
        if not frames:
            return self.spark.createDataFrame([], "spectrum_id_ int, mz double, intensity double")
        return union_by_name(frames)

    def samples(self) -> DataFrame:
        """The sample table: at most a row for each run."""
        if self._samples is not None:
            return self._samples
        name = os.path.join(self.path, SAMPLES) if self.path else ""
        return self.spark.read.parquet(name) if name and os.path.exists(name) else self.spark.createDataFrame([], "run_id string")

    def sample_variables(self) -> list[str]:
        return [c for c in self.samples().columns if c != "run_id"]

    def peak_variables(self) -> list[str]:
        """mz, intensity, then other list columns; the two alone for archives."""
        if self.kind != "native":
            return list(PEAKS)
        lists = [f.name for f in self.raw().schema.fields if isinstance(f.dataType, ArrayType)]
        return [*PEAKS, *[c for c in lists if c not in PEAKS and c not in KEYS]]

    def lists(self, *columns: str) -> DataFrame:
        """run_id, spectrum_id_ and list columns of a native dataset."""
        return self.raw().select("run_id", "spectrum_id_", *columns)

    def spectra(self, cached: bool = False):
        """The handle of all spectra. cached: its metadata are kept in memory (see operators.cache) and lists joined when asked for."""
        from spectrail.operators.handle import Handle

        return Handle.of(self, cached)

    def __reduce__(self):
        if self.path is None:
            raise CapabilityError("a dataset of frames can't be pickled")
        return _reopen, (self.path, self.representation)


def _reopen(path: str, representation: str) -> Dataset:
    return Dataset.open(SparkSession.getActiveSession() or SparkSession.builder.getOrCreate(), path, representation)
