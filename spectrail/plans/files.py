"""Datasets on disk made from the driver's tables, for the queries that write and read back.

An order is a spectrum and its lines are its points, as in `tables`. Each maker writes once for a session and input below the
folder that the driver and the executors share, and gives the dataset's path; queries that change a dataset make their own.
"""

from __future__ import annotations

import atexit
import base64
import json
import os
import shutil
import struct
import tempfile
import uuid
import zlib
from functools import cache as once
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrail import api
from spectrail.functions.vocab import translate
from spectrail.ship import ship
from spectrail.sources.archive import ARRAY_KEY, INDEX, INTENSITY_ARRAY, MZ_ARRAY
from spectrail.sources.dataset import Dataset

from . import tables


def folder(spark: SparkSession, label: str) -> str:
    """A new folder below spark.checkpoint.dir, which must be mounted everywhere; in local mode below one of our own where it is unset. Removed at exit."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = _own()
    path = os.path.join(urlparse(found).path, f"{label}-{uuid.uuid4().hex}")
    os.makedirs(path)
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


@once
def _own() -> str:
    return tempfile.mkdtemp(prefix="spectrail-files-")


def variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spectra as variables and peak lists, dealt out of order, with their place."""
    rows = translate(tables.with_lists(spark, sf_dir)).drop("_time", "spectrum_index")
    return rows.withColumn("place", F.col("spectrum_id_").cast("long")).drop("spectrum_id_")


_native: dict[tuple, str] = {}


def native(spark: SparkSession, sf_dir: str) -> Dataset:
    """A native dataset of the spectra in their order, a run a priority; shared by the queries that only read."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _native:
        path = folder(spark, "native")
        frame = variables(spark, sf_dir).drop("run_id").repartition(6, "customer")  # in no order
        api.create(spark, path, frame, order_by="place", row_group=2000)
        _native[key] = path
    return Dataset.open(spark, _native[key])


# -- archives

META = "run_id string, n long"


def archives(spark: SparkSession, sf_dir: str) -> list[str]:
    """An archive for each priority: metadata, two facet rows a spectrum of scans, one of precursors and ions for fragment
    spectra, points as they come (profile), and their centroids: those of an even quantity."""
    top = folder(spark, "archives")
    ship(spark)
    meta = tables.orders(spark, sf_dir).select(F.col("o_orderpriority").alias("run_id"), "spectrum_index", "o_orderkey", "o_orderstatus", "o_totalprice")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", (F.col("l_extendedprice") / F.lit(100.0)).alias("mz"), F.col("l_quantity").cast("double").alias("intensity"))
    own = tables.orders(spark, sf_dir).select("o_orderkey", F.col("o_orderpriority").alias("run_id"), "spectrum_index")
    points = lines.join(own, lines["l_orderkey"] == own["o_orderkey"]).select("run_id", "spectrum_index", "mz", "intensity")

    def place(run: str) -> str:
        path = os.path.join(top, run.replace(" ", "~") + ".mzpeak")
        os.makedirs(path, exist_ok=True)
        return path

    def write_meta(t: pa.Table) -> pa.Table:
        t = t.sort_by("spectrum_index")
        run, n, path = t["run_id"][0].as_py(), t.num_rows, place(t["run_id"][0].as_py())
        index, key, price, status = (t[c].to_pylist() for c in ("spectrum_index", "o_orderkey", "o_totalprice", "o_orderstatus"))
        level = [{"F": 1, "O": 2}.get(s, 3) for s in status]
        pq.write_table(pa.table({
            "index": pa.array(index, pa.int64()), "id": [f"order={k}" for k in key], "ms_level": pa.array(level, pa.int32()), "time": [(k % 3600) / 60.0 for k in key],
            "scan_polarity": pa.array([1 if k % 3 == 0 else -1 if k % 3 == 1 else None for k in key], pa.int32()),
            "spectrum_representation": ["MS:1000127" if k % 2 == 0 else "MS:1000128" for k in key], "total_ion_current": price,
            "vendor_order": pa.array(key, pa.int64()),
        }), f"{path}/m.parquet")
        scans = {"source_index": pa.array([i for i in index for _ in "ab"], pa.int64()), "scan_index": pa.array([j for _ in index for j in (1, 0)], pa.int32()), "filter_string": [f"{k}/{j}" for k in key for j in (1, 0)]}
        scans["scan_windows"] = pa.array([[{"scan_window_lower_limit": p / 10, "scan_window_upper_limit": p}] for p in price for _ in "ab"])
        pq.write_table(pa.table(scans), f"{path}/s.parquet")
        two = [i for i in range(n) if level[i] > 1]
        where = pa.array([index[i] for i in two], pa.int64())
        pq.write_table(pa.table({"source_index": where, "selected_ion_mz": pa.array([price[i] / 100 for i in two], pa.float64()), "charge_state": pa.array([level[i] for i in two], pa.int32())}), f"{path}/i.parquet")
        window = pa.array([{"isolation_window_target": price[i] / 100, "isolation_window_lower_offset": 0.5, "isolation_window_upper_offset": 1.5} for i in two], pa.struct([(f"isolation_window_{c}", pa.float64()) for c in ("target", "lower_offset", "upper_offset")]))
        pq.write_table(pa.table({"source_index": where, "precursor_index": pa.array([index[i] for i in two], pa.int32()), "isolation_window": window}), f"{path}/p.parquet")
        return pa.table({"run_id": [run], "n": pa.array([n], pa.int64())})

    def write_points(t: pa.Table) -> pa.Table:
        t = t.sort_by([("spectrum_index", "ascending"), ("intensity", "ascending")])
        run, path = t["run_id"][0].as_py(), place(t["run_id"][0].as_py())
        arrays = {"prefix": "point", "entries": [{"path": f"point.{c}", "array_type": a, "buffer_priority": "primary"} for c, a in (("first", MZ_ARRAY), ("second", INTENSITY_ARRAY))]}
        for name, some in (("profile", t), ("centroid", t.filter(pc.equal(pc.bit_wise_and(pc.cast(t["intensity"], pa.int64()), 1), 0)))):
            columns = [some[c].combine_chunks() for c in ("spectrum_index", "mz", "intensity")]
            point = pa.StructArray.from_arrays(columns, ["spectrum_index", "first", "second"])
            pq.write_table(pa.table({"point": point}).replace_schema_metadata({ARRAY_KEY: json.dumps(arrays)}), f"{path}/{name}.parquet")
        return pa.table({"run_id": [run], "n": pa.array([t.num_rows], pa.int64())})

    runs = sorted(r.run_id for r in meta.groupBy("run_id").applyInArrow(write_meta, META).collect())
    points.groupBy("run_id").applyInArrow(write_points, META).collect()
    out = []
    for run in runs:
        path = place(run)
        files = [{"name": f"{n}.parquet", "entity_type": e, "data_kind": k} for n, e, k in (("m", "Spectrum", "Metadata"), ("s", "spectrum", "scans"), ("i", "spectrum", "selected ions"), ("p", "spectrum", "precursors"), ("profile", "spectrum", "data arrays"), ("centroid", "spectrum", "peaks"))]
        files[0]["column_mapping"] = [{"path": "ms_level", "name": "ms level", "accession": "MS:1000511", "unit": None}, {"path": f"own {run}", "name": "own", "accession": "X:1", "unit": "u"}]
        with open(os.path.join(path, INDEX), "w", encoding="utf-8") as f:
            json.dump({"files": files, "metadata": {"run": {"id": run}} if run != "5-LOW" else {}}, f)
        out.append(path)
    return out


_archives: dict[tuple, list[str]] = {}
_archived: dict[tuple, str] = {}


def made_archives(spark: SparkSession, sf_dir: str) -> list[str]:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _archives:
        _archives[key] = archives(spark, sf_dir)
    return _archives[key]


def archived(spark: SparkSession, sf_dir: str, representation: str = "auto", *, own: bool = False) -> Dataset:
    """A dataset that refers to the archives; `own` makes a new one."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if own or key not in _archived:
        path = os.path.join(folder(spark, "archived"), "set")
        api.create_from_archives(spark, path, made_archives(spark, sf_dir))
        if own:
            return Dataset.open(spark, path, representation)
        _archived[key] = path
    return Dataset.open(spark, _archived[key], representation)


def zipped(spark: SparkSession, sf_dir: str) -> tuple[Dataset, list[str]]:
    """A dataset of the first two archives as ZIP files, and these."""
    top, names = folder(spark, "zipped"), []
    for path in made_archives(spark, sf_dir)[:2]:
        names.append(shutil.make_archive(os.path.join(top, os.path.basename(path)), "zip", path))
    return api.create_from_archives(spark, os.path.join(top, "set"), names), names


# -- mzML

ACTIVATION = ("MS:1000422", "MS:1002678 MS:1000598", "MS:1003294")


def mzml(spark: SparkSession, sf_dir: str) -> list[str]:
    """An mzML file for each priority, every other one packed: levels, times in minutes, precursors, and points as zlib or plain arrays of 32 or 64 bits."""
    top = folder(spark, "mzml")
    ship(spark)
    lists = tables.with_lists(spark, sf_dir).select("run_id", "spectrum_index", "ms_level", "time", "scan_polarity", "selected_ion_mz", "mz", "intensity")

    def array(values: list[float], term: str, packed: bool, kind: str) -> str:
        raw = struct.pack(f"<{len(values)}{kind}", *values)
        raw = base64.b64encode(zlib.compress(raw) if packed else raw).decode()
        return f'<binaryDataArray><cvParam accession="{"MS:1000523" if kind == "d" else "MS:1000521"}"/><cvParam accession="{"MS:1000574" if packed else "MS:1000576"}"/><cvParam accession="{term}"/><binary>{raw}</binary></binaryDataArray>'

    def write(t: pa.Table) -> pa.Table:
        import gzip

        rows = t.sort_by("spectrum_index").to_pylist()
        run = rows[0]["run_id"]
        packed = int(run[0]) % 2 == 0
        path = os.path.join(top, run.replace(" ", "~") + (".mzML.gz" if packed else ".mzML"))
        with (gzip.open if packed else open)(path, "wt", encoding="utf-8") as f:
            f.write('<?xml version="1.0"?><mzML xmlns="http://psi.hupo.org/ms/mzml"><run><spectrumList>')
            for r in rows:
                i, precursor = r["spectrum_index"], ""
                if r["selected_ion_mz"] is not None:
                    ion = r["selected_ion_mz"]
                    terms = "".join(f'<cvParam accession="{x}"/>' for x in ACTIVATION[i % 3].split())
                    precursor = f'<precursorList><precursor spectrumRef="scan={max(0, i - 1) + 1}"><isolationWindow><cvParam accession="MS:1000827" value="{ion!r}"/><cvParam accession="MS:1000828" value="0.5"/><cvParam accession="MS:1000829" value="1.5"/></isolationWindow><selectedIonList><selectedIon><cvParam accession="MS:1000744" value="{ion!r}"/></selectedIon></selectedIonList><activation>{terms}</activation></precursor></precursorList>'
                polarity = "" if r["scan_polarity"] is None else f'<cvParam accession="{"MS:1000130" if r["scan_polarity"] == 1 else "MS:1000129"}"/>'
                head = f'<spectrum index="{i}" id="scan={i + 1}" defaultArrayLength="{len(r["mz"] or [])}"><cvParam accession="MS:1000511" value="{r["ms_level"]}"/>{polarity}'
                scan = f'<scanList><scan><cvParam accession="MS:1000016" value="{r["time"]!r}" unitName="minute"/><cvParam accession="MS:1000512" value="{i} &lt; &quot;a&quot; &amp; b"/></scan></scanList>'
                data = array(r["mz"] or [], MZ_ARRAY, packed, "d") + array(r["intensity"] or [], INTENSITY_ARRAY, not packed, "f")
                f.write(f"{head}{scan}{precursor}<binaryDataArrayList>{data}</binaryDataArrayList></spectrum>")
            f.write("</spectrumList></run></mzML>")
        return pa.table({"run_id": [path], "n": pa.array([len(rows)], pa.int64())})

    return sorted(r.run_id for r in lists.groupBy("run_id").applyInArrow(write, META).collect())
