"""Point archives: a directory (or plain ZIP) of Parquet members listed in an index file.

Members are found by what they hold, never by name. Metadata columns are found by path in the schema, whole path first,
then by the last name; lists give their first element. Signal is one row a point; other layouts are refused.
"""

from __future__ import annotations

import json
import os
import re
import zipfile

import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from spectrail.errors import ArchiveError, CapabilityError, UnsupportedError
from spectrail.sources.runs import sanitised

#: Fixed values of the archive format: its index file, footer key, and PSI-MS terms of the arrays.
INDEX, ARRAY_KEY = "mzpeak_index.json", "spectrum_array_index"
MZ_ARRAY, INTENSITY_ARRAY = "MS:1000514", "MS:1000515"


def token(text: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", str(text).lower()).strip("_")


def is_archive(path: str) -> bool:
    return os.path.isfile(os.path.join(path, INDEX)) or zipfile.is_zipfile(path)


def unpack(path: str, into: str) -> str:
    """Extracts a ZIP archive; names that lead out of the folder are refused. Gives the folder with the index."""
    top = os.path.realpath(into)
    with zipfile.ZipFile(path) as z:
        for name in z.namelist():
            if not os.path.realpath(os.path.join(into, name)).startswith(top + os.sep):
                raise ArchiveError(f"{path} holds a member outside of it: {name}", member=name)
        z.extractall(into)
    if os.path.isfile(os.path.join(into, INDEX)):
        return into
    inner = [os.path.join(into, d) for d in os.listdir(into)]
    if len(inner) == 1 and os.path.isfile(os.path.join(inner[0], INDEX)):
        return inner[0]
    raise ArchiveError(f"{path} has no {INDEX}", path=path)


class Archive:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        name = os.path.join(path, INDEX)
        try:
            with open(name, encoding="utf-8") as f:
                self.index = json.load(f)
        except FileNotFoundError as e:
            raise ArchiveError(f"{path} has no {INDEX}", path=path) from e
        except ValueError as e:
            raise ArchiveError(f"{name} is not valid JSON", path=path) from e
        files = self.index.get("files") if isinstance(self.index, dict) else None
        if not isinstance(files, list) or any(not isinstance(f, dict) or not {"name", "entity_type", "data_kind"} <= f.keys() for f in files):
            raise ArchiveError(f"{name} must list files with name, entity_type and data_kind", path=path)
        self.files = files

    def member(self, entity: str, kind: str, *, needed: bool = False) -> str | None:
        for f in self.files:
            if token(f["entity_type"]) == token(entity) and token(f["data_kind"]) == token(kind):
                full = os.path.join(self.path, f["name"])
                if not os.path.exists(full):
                    raise ArchiveError(f"{self.path} lists {f['name']}, which is missing", member=f["name"])
                return full
        if needed:
            raise ArchiveError(f"{self.path} has no {entity} {kind}", entity=entity, kind=kind)
        return None

    def facet(self, kind: str) -> str | None:
        """The metadata member of spectra, or of a facet (scans, precursors, selected ions)."""
        return self.member("spectrum", kind)

    @property
    def profile(self) -> str | None:
        return self.member("spectrum", "data_arrays") or self.member("spectrum", "profile")

    @property
    def centroid(self) -> str | None:
        return self.member("spectrum", "peaks") or self.member("spectrum", "centroid")

    def run_id(self) -> str:
        own = ((self.index.get("metadata") or {}).get("run") or {}).get("id")
        return sanitised(str(own)) if own else sanitised(re.sub(r"\.mzpeak$", "", os.path.basename(os.path.normpath(self.path)), flags=re.IGNORECASE))

    def column_map(self) -> list[dict]:
        out = []
        for f in self.files:
            for m in f.get("column_mapping") or []:
                out.append({"file": f["name"], "path": m.get("path"), "name": m.get("name"), "accession": m.get("accession"), "unit": m.get("unit"), "run_id": self.run_id()})
        return out

    def validate(self) -> dict:
        """The signal description of the archive for the manifest."""
        self.member("spectrum", "metadata", needed=True)
        if not self.profile and not self.centroid:
            raise ArchiveError(f"{self.path} has neither profile nor centroid signal", path=self.path)
        for name in (self.profile, self.centroid):
            if name and (found := layout(name)) != "point":
                raise UnsupportedError(f"{name} has {found} layout; only one row a point can be read", layout=found)
        rel = lambda p: os.path.relpath(p, self.path) if p else None
        return {"layout": "point", "profile": rel(self.profile), "centroid": rel(self.centroid)}


def rows_of(name: str) -> int:
    """A member's rows, from its footer."""
    return pq.read_metadata(name).num_rows


def footer(name: str, key: str) -> str | None:
    value = (pq.read_metadata(name).metadata or {}).get(key.encode())
    return None if value is None else value.decode()


def array_index(name: str) -> dict:
    text = footer(name, ARRAY_KEY)
    try:
        found = json.loads(text) if text else {}
    except ValueError:
        found = {}
    return found if isinstance(found, dict) else {}


def layout(name: str) -> str:
    """point or chunk: by the footer's prefix, else by the columns; unknown layouts are an error."""
    prefix = array_index(name).get("prefix")
    names = pq.read_schema(name).names
    if prefix:
        kind = str(prefix).split(".")[0]
    elif "chunk" in names or any("_chunk_" in n for n in names):
        kind = "chunk"
    elif "point" in names or "mz" in names:
        kind = "point"
    else:
        raise ArchiveError(f"{name} has an unknown layout", columns=names)
    if kind not in ("point", "chunk"):
        raise ArchiveError(f"{name} has an unknown layout {kind!r}", layout=kind)
    return kind


def leaves(schema: StructType) -> dict[str, Column]:
    """Every leaf's dotted path and how to reach it."""
    out: dict[str, Column] = {}

    def walk(kind, path: str, at: Column) -> None:
        if isinstance(kind, StructType):
            for f in kind.fields:
                walk(f.dataType, f"{path}.{f.name}", at[f.name])
        elif isinstance(kind, ArrayType):
            walk(kind.elementType, path, F.get(at, F.lit(0)))
        else:
            out[path] = at

    for f in schema.fields:
        walk(f.dataType, f.name, F.col(f"`{f.name}`"))
    return out


def resolve(found: dict[str, Column], *candidates: str) -> Column | None:
    """The first candidate by whole path, else by the last name."""
    for c in candidates:
        if c in found:
            return found[c]
    for c in candidates:
        for path, column in found.items():
            if path.rsplit(".", 1)[-1] == c.rsplit(".", 1)[-1]:
                return column
    return None


def signal_columns(name: str, schema: StructType) -> tuple[Column, Column, Column]:
    """spectrum_index, m/z and intensity of a signal member: by the footer's terms (the primary arrays first), else by name."""
    found = leaves(schema)
    entries = array_index(name).get("entries") or []
    entries = sorted((e for e in entries if isinstance(e, dict)), key=lambda e: e.get("buffer_priority") != "primary")

    def array(term: str, plain: str) -> Column | None:
        for e in entries:
            if e.get("array_type") == term and (c := resolve(found, str(e.get("path")))) is not None:
                return c
        return resolve(found, f"point.{plain}", plain)

    out = resolve(found, "point.spectrum_index", "spectrum_index"), array(MZ_ARRAY, "mz"), array(INTENSITY_ARRAY, "intensity")
    if any(c is None for c in out):
        raise ArchiveError(f"{name} lacks spectrum_index, m/z or intensity", columns=list(found))
    return out


def chosen(run: dict, representation: str) -> str:
    """The signal member of a run for a representation; auto takes centroid before profile."""
    signal = run["signal"]
    want = representation if representation != "auto" else "centroid" if signal.get("centroid") else "profile"
    if not signal.get(want):
        raise CapabilityError(f"run {run['run_id']!r} has no {want} signal", run_id=run["run_id"], representation=want)
    return os.path.join(run["path"], signal[want])


def signal_points(spark: SparkSession, run: dict, representation: str) -> DataFrame:
    """spectrum_id_, mz, intensity of a run's points."""
    name = chosen(run, representation)
    df = spark.read.parquet(name)
    index, mz, intensity = signal_columns(name, df.schema)
    return df.select((index + F.lit(run["uid_base"])).cast("int").alias("spectrum_id_"), mz.cast("double").alias("mz"), intensity.cast("double").alias("intensity"))
