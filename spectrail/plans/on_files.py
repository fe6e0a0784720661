"""The registered queries that write datasets, archives and mzML files and read them back."""

from __future__ import annotations

import json
import os
import pickle
import shutil

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spectrail import api
from spectrail.errors import SpectrailError
from spectrail.functions import predicates as pr
from spectrail.operators import cache
from spectrail.sources import manifest as mf
from spectrail.sources import runs as rn
from spectrail.sources.archive import INDEX, Archive, array_index, layout
from spectrail.sources.dataset import Dataset
from spectrail.sources.mzml import pick_dissociation

from . import files, tables
from .catalog import _query

#: What is on disk: minutes and offsets have been divided and multiplied once more, run ids have no spaces.
STORED = """, stored AS (
  SELECT * REPLACE (replace(run_id, ' ', '_') AS run_id, rtime / 60::DOUBLE * 60::DOUBLE AS rtime) FROM spectra),
scanned AS (
  SELECT * REPLACE (replace(run_id, ' ', '_') AS run_id) FROM spectra)
"""
CENTROIDS = "(SELECT spectrum_id_, mz, intensity, (row_number() OVER (PARTITION BY spectrum_id_ ORDER BY mz, intensity) - 1)::INTEGER AS peak_ FROM points WHERE intensity::BIGINT % 2 = 0)"
META = 'spectrum_id_, run_id, spectrum_index, "msLevel", rtime, polarity, centroided, "precursorMz"'
NAMES = [c.strip().strip('"') for c in META.split(",")]


def _files(sql: str | None):
    return _query(None if sql is None else STORED + sql)


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _values(rows: list[tuple], names: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join(str(r) if len(r) > 1 else f'({r[0]!r})' for r in rows)}) v({names})".replace("None", "NULL")


# -- native datasets


@_files(f'SELECT {META}, tic AS "totIonCurrent", "dataOrigin", customer FROM stored')
def file_native_scan(spark, sf_dir):
    return files.native(spark, sf_dir).spectra().spectra_data(*NAMES, "totIonCurrent", "dataOrigin", "customer")


@_files("SELECT spectrum_id_, peak_, mz, intensity, sn FROM peaks")
def file_native_peaks(spark, sf_dir):
    return files.native(spark, sf_dir).spectra().peaks_data("mz", "intensity", "sn", long=True)


@_files('SELECT spectrum_id_, rtime, "precursorMz" FROM stored WHERE ((rtime BETWEEN 200 AND 1300 AND "msLevel" = 2) OR "msLevel" <> 2) AND "precursorMz" BETWEEN 900 AND 2000')
def file_native_filters(spark, sf_dir):
    return files.native(spark, sf_dir).spectra().filter_rt(200, 1300, ms_level=2).filter_precursor_mz_range(900, 2000).spectra_data("spectrum_id_", "rtime", "precursorMz")


@_files("SELECT spectrum_id_, row_number() OVER (ORDER BY CASE run_id WHEN '4-NOT_SPECIFIED' THEN 0 ELSE 1 END, spectrum_id_) - 1 AS place FROM stored WHERE \"dataOrigin\" IN ('4-NOT SPECIFIED', '1-URGENT')")
def file_native_origins(spark, sf_dir):
    return files.native(spark, sf_dir).spectra().filter_data_origin("4-NOT SPECIFIED", "1-URGENT").placed().select("spectrum_id_", "place")


@_files('SELECT spectrum_id_, "msLevel", customer, tic AS "totIonCurrent" FROM stored WHERE "msLevel" IN (2, 3)')
def file_hive_keys(spark, sf_dir):
    """A dataset with a directory for each level below each run."""
    path = files.folder(spark, "keys")
    data = api.create(spark, path, files.variables(spark, sf_dir).drop("run_id"), order_by="place", partitioning=["msLevel"])
    assert os.path.isdir(os.path.join(path, "spectra", f"run_id={data.run_ids[0]}", "ms_level=2"))
    return data.spectra().filter_ms_level(2, 3).spectra_data("spectrum_id_", "msLevel", "customer", "totIonCurrent")


@_files("SELECT DISTINCT run_id, 'polarity' AS keys FROM stored")
def file_redundant_key(spark, sf_dir):
    """Runs that are the data origins need no directory for them."""
    frame = files.variables(spark, sf_dir).drop("run_id").withColumn("polarity", F.coalesce("polarity", F.lit(-1)))
    data = api.create(spark, files.folder(spark, "redundant"), frame, order_by="place", partitioning=["dataOrigin", "polarity"])
    return _rows(spark, [(r["run_id"], ",".join(r["signal"]["partitioning"])) for r in data.manifest["runs"]], "run_id string, keys string")


@_files("""SELECT (row_number() OVER (ORDER BY "msLevel" <> 1, spectrum_id_))::INTEGER AS spectrum_id_, run_id || CASE "msLevel" WHEN 1 THEN '' ELSE '-1' END AS run_id,
  customer::DOUBLE AS customer, CASE WHEN "msLevel" <> 1 THEN 'late' END AS note, tic AS "totIonCurrent" FROM stored""")
def file_append(spark, sf_dir):
    """Runs added later, with a column of another type and one more; run ids that are taken get a suffix."""
    rows, path = files.variables(spark, sf_dir).drop("run_id"), files.folder(spark, "append")
    first = rows.where("msLevel = 1").withColumn("customer", F.col("customer").cast("int"))
    data = api.create(spark, path, first, order_by="place")
    later = rows.where("msLevel <> 1").withColumns({"customer": F.col("customer").cast("double"), "note": F.lit("late")})
    return api.append(data, later, order_by="place").spectra().spectra_data("spectrum_id_", "run_id", "customer", "note", "totIonCurrent")


@_files("SELECT run_id, 'native' AS kind, count(*) AS n_spectra, min(spectrum_id_)::BIGINT AS uid_base, 'list' AS layout, min(\"dataOrigin\") AS source FROM stored GROUP BY run_id")
def file_run_table(spark, sf_dir):
    names = ["run_id", "kind", "n_spectra", "uid_base", "layout", "source"]
    found = mf.run_table(files.native(spark, sf_dir).path)
    return _rows(spark, [tuple(r[n] for n in names) for r in found], "run_id string, kind string, n_spectra long, uid_base long, layout string, source string")


ON_DISK = [
    ("spectrum_id_", "int"), ("run_id", "string"), ("spectrum_index", "bigint"), ("ms_level", "int"), ("time", "double"), ("scan_polarity", "int"), ("spectrum_representation", "string"), ("id", "string"),
    ("acquisition_num_", "int"), ("scan_index", "int"), ("precursor_index", "int"), ("selected_ion_mz", "double"), ("isolation_window_target", "double"), ("isolation_window_lower_offset", "double"),
    ("isolation_window_upper_offset", "double"), ("total_ion_current", "double"), ("data_origin", "string"), ("customer", "bigint"), ("mz", "array<double>"), ("intensity", "array<double>"), ("sn", "array<double>"),
]


@_files(_values(ON_DISK, '"column", type'))
def file_schema(spark, sf_dir):
    """What is on disk: variables that are null throughout are not."""
    return _rows(spark, [(f.name, f.dataType.simpleString()) for f in files.native(spark, sf_dir).raw().schema.fields], "column string, type string")


VARIABLES = [
    "spectrum_id_", "run_id", "spectrum_index", "msLevel", "rtime", "polarity", "centroided", "spectrumId", "acquisitionNum", "scanIndex", "precScanNum", "precursorMz", "precursorCharge", "precursorIntensity",
    "collisionEnergy", "isolationWindowTargetMz", "isolationWindowLowerMz", "isolationWindowUpperMz", "totIonCurrent", "basePeakMZ", "basePeakIntensity", "lowMZ", "highMZ", "peaksCount", "injectionTime",
    "filterString", "scanWindowLowerLimit", "scanWindowUpperLimit", "instrumentConfigurationId", "spectrumType", "activationType", "dataOrigin", "dataStorage", "customer", "mz", "intensity", "sn",
]


@_files(_values([(v,) for v in VARIABLES], "variable"))
def file_variables(spark, sf_dir):
    """All variables that a handle gives: the vocabulary's, written or not, and the dataset's own."""
    return _rows(spark, [(v,) for v in files.native(spark, sf_dir).spectra().variables()], "variable string")


@_files("SELECT * FROM (VALUES ('mz'), ('intensity'), ('sn')) v(variable)")
def file_peak_variables(spark, sf_dir):
    return _rows(spark, [(c,) for c in files.native(spark, sf_dir).spectra().peak_variables()], "variable string")


@_files("SELECT 'native' AS kind, 5 AS runs, count(*) AS n, true AS named, true AS writes, true AS threads FROM spectra")
def file_summary(spark, sf_dir):
    h = files.native(spark, sf_dir).spectra()
    s = h.summary()
    return _rows(spark, [(s["kind"], s["runs"], h.count(), s["path"] in repr(h), h.supports_write_to(), h.options(spark)["parallelism"] > 0)], "kind string, runs int, n long, named boolean, writes boolean, threads boolean")


@_files("""SELECT (row_number() OVER (ORDER BY spectrum_id_ DESC))::INTEGER AS spectrum_id_, (rtime + 1000) / 60::DOUBLE * 60::DOUBLE AS rtime, tic AS "totIonCurrent", (SELECT count(*) FROM points p WHERE p.spectrum_id_ = s.spectrum_id_)::INTEGER AS n_peaks
FROM stored s WHERE "msLevel" = 2""")
def file_write_to(spark, sf_dir):
    """A selection, backwards and with what is overlaid, as a dataset of its own."""
    h = files.native(spark, sf_dir).spectra().filter_ms_level(2)
    h = h.take(range(h.count() - 1, -1, -1)).with_column("rtime", F.col("rtime") + 1000)
    new = h.write_to(os.path.join(files.folder(spark, "copy"), "ds"))
    return new.frame.select("spectrum_id_", "rtime", "totIonCurrent", F.size("mz").alias("n_peaks")).fillna({"n_peaks": 0}).withColumn("n_peaks", F.greatest("n_peaks", F.lit(0)))


@_files('SELECT spectrum_id_, peak_, mz, intensity FROM peaks JOIN stored USING (spectrum_id_) WHERE "msLevel" = 1 AND rtime BETWEEN 200 AND 1300')
def file_cached_peaks(spark, sf_dir):
    return files.native(spark, sf_dir).spectra(cached=True).filter_ms_level(1).filter_rt(200, 1300).peaks_data(long=True)


@_files('SELECT spectrum_id_, rtime, "precursorMz" FROM stored WHERE rtime BETWEEN 200 AND 300')
def file_cached_metadata(spark, sf_dir):
    """From memory; again after what is kept has been forgotten."""
    data = files.native(spark, sf_dir)
    assert cache.warm(data) == data.spectra().count()
    cache.invalidate(data.path)
    return data.spectra(cached=True).filter_rt(200, 300).spectra_data("spectrum_id_", "rtime", "precursorMz")


@_files('SELECT spectrum_id_, rtime FROM stored WHERE rtime BETWEEN 200 AND 900 AND "msLevel" = 2')
def file_pickled(spark, sf_dir):
    h = files.native(spark, sf_dir).spectra().filter_rt(200, 900).filter_ms_level(2)
    return pickle.loads(pickle.dumps(h)).spectra_data("spectrum_id_", "rtime")


@_files("SELECT run_id, count(*) AS n, sum(tic) AS tic FROM stored WHERE \"msLevel\" = 3 GROUP BY run_id")
def file_view(spark, sf_dir):
    """The variables as a temporary view for SQL."""
    h = files.native(spark, sf_dir).spectra().filter_ms_level(3)
    name = h.as_view("spectra_of_level_3")
    out = spark.sql(f"SELECT run_id, count(*) AS n, sum(totIonCurrent) AS tic FROM {name} GROUP BY run_id")
    assert h.drop_view(name)
    return out


@_files('SELECT spectrum_id_::VARCHAR AS name FROM spectra WHERE "msLevel" = 2')
def file_spectra_names(spark, sf_dir):
    return files.native(spark, sf_dir).spectra().filter_ms_level(2).spectra_names()


@_files('SELECT CASE WHEN "msLevel" > 1 THEN spectrum_index END::INTEGER AS "precScanNum" FROM spectra')
def file_prec_scan_num(spark, sf_dir):
    return files.native(spark, sf_dir).spectra().prec_scan_num()


@_files("SELECT centroided FROM spectra")
def file_centroided(spark, sf_dir):
    return files.native(spark, sf_dir).spectra().centroided()


@_files("SELECT NULL::BOOLEAN AS smoothed FROM spectra")
def file_smoothed(spark, sf_dir):
    return files.native(spark, sf_dir).spectra().smoothed()


@_files("SELECT true AS here, count(*) AS n FROM spectra")
def file_data_storage(spark, sf_dir):
    data = files.native(spark, sf_dir)
    return data.spectra().data_storage().groupBy((F.col("dataStorage") == data.path).alias("here")).agg(F.count("*").alias("n"))


@_files('SELECT spectrum_id_, row_number() OVER (ORDER BY spectrum_id_) - 1 AS place FROM spectra WHERE "msLevel" <> 2')
def file_ids_in_order(spark, sf_dir):
    """Ids as they come, numbered as they come."""
    got = files.native(spark, sf_dir).spectra().filter_ms_level(1, 3).ids().toArrow()["spectrum_id_"].combine_chunks()
    return spark.createDataFrame(pa.table({"spectrum_id_": got, "place": pa.array(range(len(got)), pa.int64())}))


@_files("""SELECT spectrum_id_, peak_, mz, row_number() OVER (ORDER BY spectrum_id_, peak_) - 1 AS place FROM peaks JOIN spectra USING (spectrum_id_) WHERE "msLevel" = 3""")
def file_flat_peaks(spark, sf_dir):
    """One peak column of many spectra, one after another."""
    got = files.native(spark, sf_dir).spectra().filter_ms_level(3).flat("mz").toArrow()
    return spark.createDataFrame(got.append_column("place", pa.array(range(got.num_rows), pa.int64())))


@_files("SELECT spectrum_id_, -rtime AS rtime, spectrum_id_ % 3 AS third FROM stored")
def file_overlay_values(spark, sf_dir):
    """Values for each spectrum, in order, and a column that hides one on disk; reset forgets them."""
    h = files.native(spark, sf_dir).spectra()
    o = h.with_column("third", [(i + 1) % 3 for i in range(h.count())]).with_column("rtime", -F.col("rtime"))
    assert "third" not in o.reset().variables()
    return o.frame.select("spectrum_id_", "rtime", F.col("third").cast("int").alias("third"))


@_files("""SELECT 'both' AS part, spectrum_id_ FROM stored WHERE "msLevel" = 1 AND rtime < 900 UNION ALL SELECT 'first', spectrum_id_ FROM stored WHERE "msLevel" = 1 AND rtime > 900""")
def file_set_operations(spark, sf_dir):
    """Ids in both of two selections, and in the first alone."""
    h = files.native(spark, sf_dir).spectra()
    a, b = h.filter_ms_level(1).ids(), h.filter_rt(900, float("inf")).ids()
    first = a.intersect(b).where("true")
    return a.subtract(b).select(F.lit("both").alias("part"), "spectrum_id_").unionByName(first.select(F.lit("first").alias("part"), "spectrum_id_").join(h.frame.where("rtime > 900").select("spectrum_id_"), "spectrum_id_", "left_semi"))


@_files("""SELECT spectrum_id_, "precursorMz" FROM spectra WHERE "precursorMz" BETWEEN 1000::DOUBLE - (1000::DOUBLE * 2000 / 1000000) AND 1000::DOUBLE + (1000::DOUBLE * 2000 / 1000000)
  OR "precursorMz" BETWEEN 1500::DOUBLE - (1500::DOUBLE * 20000 / 1000000 + 0.5) AND 1500::DOUBLE + (1500::DOUBLE * 20000 / 1000000 + 0.5)""")
def file_ppm_windows(spark, sf_dir):
    return files.native(spark, sf_dir).spectra().filter_precursor_mz_values([1000, 1500], ppm=[2000, 20000], tolerance=[0, 0.5]).spectra_data("spectrum_id_", "precursorMz")


@_files("""SELECT spectrum_id_, "precursorMz" FROM spectra WHERE EXISTS (SELECT 1 FROM range(400) r(i) WHERE "precursorMz" BETWEEN (10 + 12.5 * i)::DOUBLE - 0.75 AND (10 + 12.5 * i)::DOUBLE + 0.75)""")
def file_many_windows(spark, sf_dir):
    """Windows too many for a condition are joined by ranges."""
    return files.native(spark, sf_dir).spectra().filter_precursor_mz_values([10 + 12.5 * i for i in range(400)], ppm=0, tolerance=0.75).spectra_data("spectrum_id_", "precursorMz")


@_files("""SELECT spectrum_id_ FROM spectra WHERE ("precursorMz" >= 1234.567 AND "dataOrigin" = '4-NOT SPECIFIED') OR "dataOrigin" = 'it''s' """)
def file_literals(spark, sf_dir):
    """Numbers and strings as SQL text that reads back exactly."""
    test = f"(precursorMz >= {pr.exact(1234.567)} AND precursorMz <= {pr.exact(float('inf'))} AND dataOrigin = {pr.quoted('4-NOT SPECIFIED')}) OR dataOrigin = {pr.quoted(chr(39).join(('it', 's')))}"
    return files.native(spark, sf_dir).spectra().frame.where(F.expr(test)).select("spectrum_id_")


@_files('SELECT "msLevel" AS value, count(*) AS n, min(spectrum_id_) AS first FROM spectra GROUP BY "msLevel"')
def file_split(spark, sf_dir):
    parts = files.native(spark, sf_dir).spectra().split("msLevel")
    return _rows(spark, [(v, h.count(), h.ids().first()[0]) for v, h in parts.items()], "value int, n long, first int")


@_files('SELECT DISTINCT "msLevel" FROM spectra')
def file_ms_levels(spark, sf_dir):
    return _rows(spark, [(x,) for x in files.native(spark, sf_dir).spectra().unique_ms_levels()], "msLevel int")


@_files("SELECT spectrum_id_, run_id FROM stored")
def file_run_of_ids(spark, sf_dir):
    """The run of each id, from the manifest alone."""
    m = files.native(spark, sf_dir).manifest
    ids = list(range(1, mf.n_spectra(m) + 1))
    return spark.createDataFrame(pa.table({"spectrum_id_": pa.array(ids, pa.int32()), "run_id": rn.run_of(m, ids)}))


@_files("SELECT spectrum_id_, subject, timepoint, ratio FROM stored LEFT JOIN (SELECT * REPLACE (replace(run_id, ' ', '_') AS run_id) FROM samples) USING (run_id) WHERE timepoint >= 12 AND ratio < 2.5")
def file_sample_table(spark, sf_dir):
    """A sample table written after the fact, replaced once; a filter on it and its columns."""
    path = files.folder(spark, "samples")
    shutil.copytree(files.native(spark, sf_dir).path, path, dirs_exist_ok=True)
    data = Dataset.open(spark, path)
    rows = tables.samples(spark, sf_dir).withColumn("run_id", F.replace("run_id", F.lit(" "), F.lit("_")))
    api.set_run_data(data, rows.select("run_id", F.lit("old").alias("subject")))
    api.set_run_data(data, rows)
    assert api.run_data(data).count() == rows.count() and data.manifest["generation"] == 3
    return data.spectra().filter_sample_data("timepoint >= 12 AND ratio < 2.5").spectra_data("spectrum_id_", "subject", "timepoint", "ratio")


@_files("SELECT * FROM (VALUES (0::BIGINT, true, 0::BIGINT)) v(n, has_peaks, runs)")
def file_empty_dataset(spark, sf_dir):
    data = api.create(spark, files.folder(spark, "empty"), files.variables(spark, sf_dir).where("false"), order_by="place")
    return _rows(spark, [(data.spectra().frame.count(), {"mz", "intensity"} <= set(data.spectra().variables()), len(data.run_ids))], "n long, has_peaks boolean, runs long")


@_files("""SELECT run_id, count(*) AS n, min(spectrum_id_) AS first FROM (
  SELECT run_id, spectrum_id_ FROM stored UNION ALL SELECT 'native', (SELECT count(*) FROM stored)::INTEGER + (row_number() OVER (ORDER BY spectrum_id_))::INTEGER FROM stored WHERE "msLevel" = 1) GROUP BY run_id""")
def file_foreign_manifest(spark, sf_dir):
    """A dataset of the same layout under a manifest of another name and format is read and extended; its keys are kept."""
    path = files.folder(spark, "foreign")
    shutil.copytree(files.native(spark, sf_dir).path, path, dirs_exist_ok=True)
    own = json.load(open(os.path.join(path, mf.FILE), encoding="utf-8"))
    os.remove(os.path.join(path, mf.FILE))
    with open(os.path.join(path, "Foreign.json"), "w", encoding="utf-8") as f:
        json.dump(own | {"format": "Foreign", "provenance": {"by": "hand"}}, f)
    data = Dataset.open(spark, path)
    data = api.append(data, files.variables(spark, sf_dir).where("msLevel = 1").drop("run_id", "dataOrigin"), order_by="place")
    assert mf.read(path)["provenance"] == {"by": "hand"} and mf.read(path)["format"] == "Foreign" and not os.path.exists(os.path.join(path, mf.FILE))
    return data.spectra().frame.groupBy("run_id").agg(F.count("*").alias("n"), F.min("spectrum_id_").alias("first"))


@_files(_values([("format", "spectrail-dataset"), ("major", "0"), ("generation", "2"), ("created", "2"), ("kept", "[1, 2]"), ("next_base", "7")], "field, value"))
def file_manifest_fields(spark, sf_dir):
    """A manifest written twice: what it says, keys that are not ours, and a date of the right form."""
    path = files.folder(spark, "manifest")
    mf.write(path, mf.new() | {"own": [1, 2]})
    m = mf.write(path, mf.add_run(mf.add_run(mf.read(path), "r1", "native", "a", 4, {}), "r2", "native", "b", 2, {}))
    m = mf.read(path)
    created = str(len([p for p in m["created"].split("T") if p]))
    rows = [("format", m["format"]), ("major", str(mf.major(m["version"]))), ("generation", str(m["generation"])), ("created", created), ("kept", str(m["own"])), ("next_base", str(mf.next_base(m)))]
    return _rows(spark, rows, "field string, value string")


NAMED = [("/data/a b.mzML.gz", "a_b"), ("QC01.mzML", "QC01"), ("qc01.raw", "qc01-1"), ("C:\\d\\..x.raw", "x"), ("__", "run"), ("t@1/é$ü.mzXML", "run-1"), ("QC01", "QC01-2"), ("x.y.z", "x.y")]


@_files(_values([(i, r) for i, (_, r) in enumerate(NAMED)], "place, run_id"))
def file_run_ids(spark, sf_dir):
    """Run ids of files: without folder and endings, only safe characters, different by more than case."""
    return _rows(spark, list(enumerate(rn.unique([rn.of_file(n) for n, _ in NAMED]))), "place int, run_id string")


ERRORS = [
    ("a place beyond the end", "reference"), ("a name that is not there", "reference"), ("an unknown variable", "semantic"), ("an unknown peak column", "unsupported"), ("ids replaced", "unsupported"), ("peaks replaced", "unsupported"),
    ("too few values", "semantic"), ("an id of no run", "reference"), ("no dataset", "format"), ("a full folder", "format"), ("a stale manifest", "stale"), ("two writers", "conflict"), ("no archive", "archive"),
    ("an unknown run in the sample table", "study"), ("a sample column that hides a variable", "semantic"), ("no sample table", "capability"), ("an unknown representation", "capability"), ("a projection of a native dataset", "unsupported"),
    ("points of a native dataset", "unsupported"), ("runs that differ by case", "study"), ("a missing key", "semantic"), ("no such file", "format"), ("a file of no spectra", "semantic"),
]


@_files(_values(ERRORS, '"case", kind'))
def file_errors(spark, sf_dir):
    """What is refused, and with which error."""
    data = files.native(spark, sf_dir)
    h, m = data.spectra(), data.manifest
    path = files.folder(spark, "errors")
    mf.write(path, mf.new())
    old = mf.read(path)
    mf.write(path, old)
    lock = files.folder(spark, "locked")
    mf.write(lock, mf.new())

    def both():
        with mf.locked(lock), mf.locked(lock):
            pass

    todo = [
        lambda: h.take([0, 10**9]), lambda: h.take(["1", "nobody"]), lambda: h.spectra_data("nothing"), lambda: h.peaks_data("nothing"), lambda: h.with_column("spectrum_id_", F.lit(1)), lambda: h.with_column("mz", F.lit(1)),
        lambda: h.with_column("x", [1, 2]), lambda: rn.run_of(m, [0]), lambda: Dataset.open(spark, files.folder(spark, "none")), lambda: api.create(spark, data.path, h.frame), lambda: mf.write(path, old), both,
        lambda: api.create_from_archives(spark, os.path.join(files.folder(spark, "bad"), "ds"), [path]), lambda: api.set_run_data(data, _rows(spark, [("none", 1)], "run_id string, x int")), lambda: api.set_run_data(data, _rows(spark, [("1-URGENT", 1)], "run_id string, rtime int")),
        lambda: h.filter_sample_data("x > 1"), lambda: Dataset(spark, data.path, "both"), lambda: api.build_projection(data), lambda: h.filter_contains_mz(100.0), lambda: mf.add_run(m, "1-urgent", "native", "x", 1, {}),
        lambda: api.create(spark, files.folder(spark, "key"), files.variables(spark, sf_dir), partitioning=["nothing"]), lambda: api.from_mzml(spark, ["/none.mzML"], path), lambda: api.from_mzml(spark, [os.path.join(data.path, mf.FILE)], path),
    ]
    found = []
    for (case, _), act in zip(ERRORS, todo, strict=True):
        try:
            act()
            found.append((case, "none"))
        except SpectrailError as e:
            found.append((case, e.kind))
    return _rows(spark, found, "case string, kind string")


# -- archives


@_files(f"""SELECT {META}, k || '/0' AS "filterString", tic / 10 AS "scanWindowLowerLimit", 2 AS n_scans, CASE WHEN "msLevel" > 1 THEN 1 END AS n_precursors, CASE WHEN "msLevel" > 1 THEN "msLevel" END AS "precursorCharge",
  "precursorMz" - 0.5::DOUBLE AS "isolationWindowLowerMz", 'order=' || k AS "spectrumId", k AS vendor_order FROM scanned""")
def archive_scan(spark, sf_dir):
    """The index of five archives: metadata, first rows of the facets and their counts, columns of the vendor's own."""
    return files.archived(spark, sf_dir).spectra().spectra_data(*NAMES, "filterString", "scanWindowLowerLimit", "n_scans", "n_precursors", "precursorCharge", "isolationWindowLowerMz", "spectrumId", "vendor_order")


@_files("SELECT spectrum_id_, (row_number() OVER (PARTITION BY spectrum_id_ ORDER BY mz, intensity) - 1)::INTEGER AS peak_, mz, intensity FROM points")
def archive_profile_peaks(spark, sf_dir):
    return files.archived(spark, sf_dir, "profile").spectra().peaks_data(long=True)


@_files(f"SELECT spectrum_id_, peak_, mz, intensity FROM {CENTROIDS}")
def archive_centroid_peaks(spark, sf_dir):
    return files.archived(spark, sf_dir, "centroid").spectra().peaks_data(long=True)


@_files(f"SELECT spectrum_id_, peak_, intensity FROM {CENTROIDS} JOIN spectra USING (spectrum_id_) WHERE \"msLevel\" = 2 AND run_id = '2-HIGH'")
def archive_auto_peaks(spark, sf_dir):
    """Without a wish centroids are taken; of a selection only its points."""
    h = files.archived(spark, sf_dir).spectra().filter_ms_level(2)
    return h._with(h.frame.where("run_id = '2-HIGH'")).peaks_data("intensity", long=True)


@_files(f'SELECT spectrum_id_, coalesce(sum(intensity), 0) AS "ionCount" FROM spectra LEFT JOIN {CENTROIDS} USING (spectrum_id_) WHERE "msLevel" = 3 GROUP BY spectrum_id_')
def archive_ion_count(spark, sf_dir):
    return files.archived(spark, sf_dir).spectra().filter_ms_level(3).ion_count()


@_files("""SELECT spectrum_id_, coalesce(hit, false) AS contains FROM spectra LEFT JOIN (SELECT DISTINCT spectrum_id_, true AS hit FROM points WHERE mz BETWEEN 99 AND 101) USING (spectrum_id_) WHERE "msLevel" = 1""")
def archive_contains_flag(spark, sf_dir):
    return files.archived(spark, sf_dir, "profile").spectra().filter_ms_level(1).contains_mz(100, tolerance=1, ppm=0)


HIT = "SELECT DISTINCT spectrum_id_ FROM points WHERE mz BETWEEN 299 AND 301 OR mz BETWEEN 99.5 AND 100.5"


@_files(f"SELECT way, spectrum_id_ FROM ({HIT}) CROSS JOIN (VALUES ('points'), ('one run sorted'), ('sorted'), ('dropped')) v(way)")
def archive_projection(spark, sf_dir):
    """A search without sorted copies, with one of them, with all, and after they were dropped."""
    data = files.archived(spark, sf_dir, "profile", own=True)

    def found(way: str, expected: bool) -> DataFrame:
        assert mf.has_projection(data.manifest, data.run_ids, "mzsorted") == expected
        rows = data.spectra().filter_contains_mz([300, 100], tolerance=[1, 0.5], ppm=0).ids()
        return spark.createDataFrame(rows.toArrow()).select(F.lit(way).alias("way"), "spectrum_id_")

    out = found("points", False)
    api.build_projection(data, data.run_ids[:1])
    out = out.unionByName(found("one run sorted", False))
    api.build_projection(data)
    out = out.unionByName(found("sorted", True))
    api.drop_projection(data)
    return out.unionByName(found("dropped", False))


@_files("SELECT run_id, 'profile.parquet' AS source, 1::BIGINT AS generation, true AS written FROM stored GROUP BY run_id")
def archive_projection_books(spark, sf_dir):
    data = files.archived(spark, sf_dir, "profile", own=True)
    api.build_projection(data)
    rows = []
    for r in data.manifest["runs"]:
        p = r["projections"]["mzsorted"]
        rows.append((r["run_id"], p["source"], p["generation"], os.path.isdir(os.path.join(data.path, "index", "projections", "mzsorted", f"run_id={r['run_id']}"))))
    return _rows(spark, rows, "run_id string, source string, generation long, written boolean")


@_files("SELECT run_id, count(*) AS n, 0::BIGINT AS falls FROM points JOIN stored USING (spectrum_id_) GROUP BY run_id UNION ALL SELECT 'index ' || run_id, count(*), 0 FROM stored GROUP BY run_id")
def archive_sorted_copies(spark, sf_dir):
    """Points of the sorted copies, and index rows, and how often one is below the one before it in its file."""
    data = files.archived(spark, sf_dir, "profile", own=True)
    api.build_projection(data)

    def falls(folder: str, by: str, name) -> DataFrame:
        rows = spark.read.parquet(folder).select(F.col("run_id").cast("string").alias("run_id"), F.col(by).alias("v"), F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i"))
        rows = rows.withColumn("down", F.coalesce(F.col("v") < F.lag("v").over(Window.partitionBy("f").orderBy("i")), F.lit(False)))
        return rows.groupBy(name.alias("run_id")).agg(F.count("*").alias("n"), F.count_if("down").alias("falls"))

    points = falls(os.path.join(data.path, "index", "projections", "mzsorted"), "mz", F.col("run_id"))
    return points.unionByName(falls(os.path.join(data.path, "index", "spectra"), "spectrum_id_", F.concat(F.lit("index "), "run_id")))


@_files("SELECT spectrum_id_, rtime, \"msLevel\" FROM scanned WHERE run_id = '2-HIGH'")
def archive_zip(spark, sf_dir):
    """ZIP archives; spectra are found by the origin that the handle shows."""
    data, names = files.zipped(spark, sf_dir)
    origins = [r[0] for r in data.spectra().frame.select("dataOrigin").distinct().orderBy("dataOrigin").collect()]
    assert origins == sorted(os.path.abspath(n) for n in names) and [r["source"] for r in mf.run_table(data.path)] == origins
    return data.spectra().filter_data_origin(origins[1]).spectra_data("spectrum_id_", "rtime", "msLevel")


@_files("SELECT run_id, count(*) AS n, true AS inside FROM stored GROUP BY run_id")
def archive_copy(spark, sf_dir):
    """Archives copied into the dataset are read from there, also after the dataset was opened anew."""
    path = os.path.join(files.folder(spark, "copies"), "ds")
    data = api.create_from_archives(spark, path, files.made_archives(spark, sf_dir), link="copy")
    inside = {r["run_id"]: r["path"].startswith(path) for r in data.manifest["runs"]}
    rows = data.spectra().frame.groupBy("run_id").agg(F.count("*").alias("n"))
    return rows.join(F.broadcast(_rows(spark, list(inside.items()), "run_id string, inside boolean")), "run_id")


@_files("SELECT run_id, count(*) AS n, min(spectrum_id_) AS first, max(spectrum_id_) AS last FROM stored GROUP BY run_id")
def archive_added_later(spark, sf_dir):
    path, made = os.path.join(files.folder(spark, "later"), "ds"), files.made_archives(spark, sf_dir)
    api.create_from_archives(spark, path, made[:2])
    data = api.add_archives(spark, path, made[2:])
    return data.spectra().frame.groupBy("run_id").agg(F.count("*").alias("n"), F.min("spectrum_id_").alias("first"), F.max("spectrum_id_").alias("last"))


@_files("SELECT 'ms_level' AS path, 'MS:1000511' AS accession, '1-URGENT' AS run_id UNION ALL SELECT DISTINCT 'own ' || \"dataOrigin\", 'X:1', run_id FROM stored")
def archive_column_map(spark, sf_dir):
    """Where columns come from, the first of each path and term."""
    data = files.archived(spark, sf_dir)
    found = json.load(open(os.path.join(data.path, "index", "column_map.json"), encoding="utf-8"))
    return _rows(spark, [(m["path"], m["accession"], m["run_id"]) for m in found], "path string, accession string, run_id string")


@_files("SELECT DISTINCT run_id, 'point' AS layout, 'point' AS prefix, 2 AS arrays, true AS metadata, 'profile.parquet' AS profile, 'centroid.parquet' AS centroid FROM stored")
def archive_members(spark, sf_dir):
    """Members by what they hold, whatever they are called, and what their footers say."""
    rows = []
    for path in files.made_archives(spark, sf_dir):
        a = Archive(spark, path)
        signal, footer = a.validate(), array_index(a.profile)
        rows.append((a.run_id(), layout(a.centroid), footer["prefix"], len(footer["entries"]), a.member("spectrum", "metadata", needed=True).endswith("m.parquet"), signal["profile"], signal["centroid"]))
    return _rows(spark, rows, "run_id string, layout string, prefix string, arrays int, metadata boolean, profile string, centroid string")


@_files("SELECT 'archive' AS kind, 5 AS runs, 'centroid' AS representation, 2 AS peaks")
def archive_summary(spark, sf_dir):
    h = files.archived(spark, sf_dir, "centroid").spectra()
    s = h.summary()
    return _rows(spark, [(s["kind"], s["runs"], s["representation"], len(h.peak_variables()))], "kind string, runs int, representation string, peaks int")


@_files("SELECT run_id, count(*) AS n FROM stored GROUP BY run_id")
def archive_arrivals(spark, sf_dir):
    """Archives that come into a watched folder join a dataset, once each."""
    from spectrail.streaming.arrivals import watch

    top = files.folder(spark, "arrivals")
    inbox, path = os.path.join(top, "in"), os.path.join(top, "ds")
    os.makedirs(path)
    mf.write(path, mf.new())
    made = files.made_archives(spark, sf_dir)
    for some in (made[:3], made):
        for a in some:
            shutil.copytree(a, os.path.join(inbox, os.path.basename(a)), dirs_exist_ok=True)
        watch(spark, inbox, path, os.path.join(top, "seen")).awaitTermination()
    assert os.path.exists(os.path.join(inbox, os.path.basename(made[0]), INDEX))
    return Dataset.open(spark, path).spectra().frame.groupBy("run_id").agg(F.count("*").alias("n"))


# -- mzML

METHODS = "['beam-type collision-induced dissociation', 'electron transfer dissociation', 'electron activated dissociation']"


@_files(f"""SELECT spectrum_id_, run_id AS run_id, spectrum_index, "msLevel", rtime / 60::DOUBLE * 60::DOUBLE AS rtime, polarity, "precursorMz", CASE WHEN "msLevel" > 1 THEN (greatest(spectrum_index, 1))::INTEGER END AS "precScanNum",
  CASE WHEN "msLevel" > 1 THEN ({METHODS})[(spectrum_index % 3) + 1] END AS "activationType", (SELECT count(*) FROM points p WHERE p.spectrum_id_ = s.spectrum_id_)::INTEGER AS "peaksCount",
  spectrum_index || ' < "a" & b' AS "filterString"
FROM (SELECT * REPLACE (replace(run_id, ' ', '~') AS run_id) FROM spectra) s""".replace("run_id AS run_id,", "replace(run_id, '~', '_') AS run_id,"))
def mzml_scan(spark, sf_dir):
    """mzML files, plain and packed, converted into a dataset: a run a file, scan numbers and dissociation methods."""
    return _converted(spark, sf_dir).spectra().spectra_data("spectrum_id_", "run_id", "spectrum_index", "msLevel", "rtime", "polarity", "precursorMz", "precScanNum", "activationType", "peaksCount", "filterString")


@_files("SELECT spectrum_id_, peak_, mz, intensity FROM peaks")
def mzml_peaks(spark, sf_dir):
    """Points of 64 and 32 bits, with and without zlib."""
    return _converted(spark, sf_dir).spectra().peaks_data(long=True)


_converted_: dict[tuple, str] = {}


def _converted(spark: SparkSession, sf_dir: str) -> Dataset:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _converted_:
        path = os.path.join(files.folder(spark, "converted"), "ds")
        _converted_[key] = api.from_mzml(spark, files.mzml(spark, sf_dir), path).data.path
    return Dataset.open(spark, _converted_[key])


TERMS = [("MS:1000133 MS:1000422", "collision-induced dissociation"), ("MS:1002678 MS:1003294", "electron activated dissociation"), ("MS:1002679 MS:1000045", "supplemental collision-induced dissociation"), ("MS:1002631", None), ("", None)]


@_files(_values([(t, m) for t, m in TERMS], "terms, method"))
def mzml_dissociation(spark, sf_dir):
    """The method of an activation: the first that does not only supplement."""
    return _rows(spark, [(t, pick_dissociation(t.split())) for t, _ in TERMS], "terms string, method string")
