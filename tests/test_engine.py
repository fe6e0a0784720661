import json
import os
import pickle
import shutil
import zipfile

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from fixtures import TINY, archive, large, mzml, tiny
from spectrail import api
from spectrail.errors import CapabilityError, ConflictError, FormatError, ReadOnlyError, ReferenceError, SemanticError, StaleError, StudyError, UnsupportedError, ArchiveError
from spectrail.functions import peaks as pk
from spectrail.functions import predicates as pr
from spectrail.functions.vocab import encode, translate
from spectrail.operators import cache
from spectrail.sources import manifest as mf
from spectrail.sources import runs as rn
from spectrail.sources.mzml import read_mzml


def ids(handle):
    return [r[0] for r in handle.ids().collect()]


@pytest.fixture(scope="module")
def big(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("big") / "ds")
    return api.create(spark, path, large(spark).repartition(3), order_by="place", row_group=250)


@pytest.fixture(scope="module")
def pair(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("pair")
    a, b = archive(top, "QC01.mzpeak", 6, run_id="QC01"), archive(top, "QC02.mzpeak", 4, offset=10000.0)
    return api.create_from_archives(spark, str(top / "ds"), [a, b])


# -- run ids, manifest


def test_run_ids():
    assert rn.of_file("/x/a b.mzML.gz") == "a_b" and rn.of_file("C:\\d\\..x.raw") == "x" and rn.sanitised("__") == "run"
    assert rn.unique(["a", "A", "a-1", "a"]) == ["a", "A-2", "a-1", "a-3"] or len({i.lower() for i in rn.unique(["a", "A", "a-1", "a"])}) == 4
    for bad in ("", ".x", "_x", "a b"):
        with pytest.raises(SemanticError):
            rn.check_ids([bad])
    with pytest.raises(SemanticError):
        rn.check_ids(["a", "A"])


def test_blocks_and_lookup():
    m = mf.new()
    for i, n in (("a", 3), ("b", 2), ("c", 4)):
        m = mf.add_run(m, i, "native", i, n, {})
    assert [r["uid_base"] for r in m["runs"]] == [1, 4, 6] and mf.n_spectra(m) == 9 and mf.next_base(m) == 10
    assert rn.run_of(m, [9, 1, 4]) == ["c", "a", "b"]
    assert rn.id_ranges(m, {"a", "b"}) == [(1, 5)] and rn.id_ranges(m, {"a", "c"}) == [(1, 3), (6, 9)]
    with pytest.raises(ReferenceError):
        rn.run_of(m, [10])
    with pytest.raises(StudyError):
        mf.add_run(m, "A", "native", "x", 1, {})


def test_manifest_write_and_conflicts(tmp_path):
    p = str(tmp_path)
    m = mf.new() | {"note": {"deep": [1], "x": 0.1 + 0.2}}
    m = mf.write(p, m)
    assert mf.read(p)["note"] == {"deep": [1], "x": 0.1 + 0.2} and m["generation"] == 1
    newer = mf.write(p, m)
    assert newer["generation"] == 2
    with pytest.raises(StaleError):
        mf.write(p, m)
    os.mkdir(os.path.join(p, mf.LOCK))
    with pytest.raises(ConflictError):
        mf.write(p, newer)
    os.rmdir(os.path.join(p, mf.LOCK))
    for text in ("{", "[]", json.dumps(m | {"format": "other"}), json.dumps(m | {"version": "1.0.0"})):
        with open(mf.manifest_path(p), "w") as f:
            f.write(text)
        with pytest.raises(FormatError):
            mf.load(p)


# -- native datasets


def test_tiny_round_trip(spark, tmp_path):
    path = str(tmp_path / "ds")
    ds = api.create(spark, path, tiny(spark))
    assert [(r["run_id"], r["n_spectra"], r["uid_base"]) for r in mf.run_table(path)] == [("file-a", 2, 1), ("file-b", 1, 3)]
    h = ds.spectra()
    rows = h.spectra_data("spectrum_id_", "rtime", "precursorMz", "dataOrigin", "polarity", "spectrum_index").collect()
    assert [tuple(r) for r in rows] == [(1, 1.0, None, "file-a", None, 0), (2, 2.0, None, "file-a", None, 1), (3, 3.0, 110.5, "file-b", None, 0)]
    assert [[tuple(p) for p in r.peaks] for r in h.peaks_data().collect()] == [[(100.0, 10.0), (110.0, 20.0)], [(101.0, 11.0), (111.0, 21.0)], [(102.0, 12.0), (112.0, 22.0)]]
    disk = pq.read_schema(next(os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")))
    assert {"ms_level", "time", "selected_ion_mz", "spectrum_index", "data_origin"} <= set(disk.names) and "rtime" not in disk.names and disk.field("spectrum_index").type == pa.int64()
    moved = str(tmp_path / "elsewhere")
    shutil.move(path, moved)
    assert api.open_dataset(spark, moved).count() == 3
    with pytest.raises(FormatError):
        api.create(spark, moved, tiny(spark))


def test_rich_encodings(spark, tmp_path):
    schema = "msLevel int, rtime double, polarity int, centroided boolean, precursorMz double, isolationWindowTargetMz double, isolationWindowLowerMz double, isolationWindowUpperMz double, peaksCount int, dataOrigin string, flag string, mz array<double>, intensity array<double>"
    rows = [(1, 60.0, 1, False, None, None, None, None, 2, "a.mzML", "x", [1.0], [2.0]), (2, 120.0, 1, True, 500.25, 500.5, 500.0, 501.5, 2, "a.mzML", "y", [1.0], [2.0]), (2, 180.0, 0, True, 700.5, 700.5, 700.0, 701.0, 2, "b.mzML", "z", [1.0], [2.0])]
    df = spark.createDataFrame(rows, schema)
    disk = encode(df).drop("mz", "intensity").toPandas()
    assert disk.time.tolist() == [1, 2, 3] and disk.scan_polarity.tolist() == [1, 1, -1] and disk.spectrum_representation.tolist() == ["MS:1000128", "MS:1000127", "MS:1000127"]
    assert disk.isolation_window_lower_offset.tolist()[1:] == [0.5, 0.5] and disk.isolation_window_upper_offset.tolist()[1:] == [1.0, 0.5] and disk.number_of_data_points.tolist() == [2, 2, 2]
    ds = api.create(spark, str(tmp_path / "ds"), df.coalesce(1))
    back = ds.spectra().spectra_data(*[c for c in df.columns]).collect()
    assert [tuple(r) for r in back] == rows
    with pytest.raises(SemanticError):
        encode(df.withColumn("RTime", F.lit(1)).select("RTime", "flag"))


def test_run_cutting_rules(spark, tmp_path):
    def made(name, origins, **extra):
        rows = [(1, float(i), None, o, 1.0, [1.0], [1.0]) for i, o in enumerate(origins)]
        df = spark.createDataFrame(rows, TINY).coalesce(1)
        for k, v in extra.items():
            df = df.withColumn(k, v)
        return [(r["run_id"], r["n_spectra"]) for r in mf.run_table(api.create(spark, str(tmp_path / name), df).path)]

    assert made("interleaved", ["a", "b", "a", "b"]) == [("native", 4)]
    assert made("missing", ["a", None]) == [("native", 2)]
    assert made("same-base", ["x/a.mzML", "y/A.raw"]) == [("a", 1), ("A-1", 1)]
    assert made("own", ["a", "a", "a"], run_id=F.when(F.col("rtime") < 2, "r1").otherwise("r2")) == [("r1", 2), ("r2", 1)]
    with pytest.raises(SemanticError):
        made("torn", ["a", "a", "a"], run_id=F.when(F.col("rtime") == 1, "r1").otherwise("r2"))


def test_annotations_and_padding(spark, tmp_path):
    rows = [([1.0, 2.0], [3.0, 4.0], [5.5, None], [3, 1]), ([1.0], [2.0], [float("inf")], None), ([], [], [], [])]
    df = spark.createDataFrame(rows, "mz array<double>, intensity array<double>, sn array<double>, contributors array<int>").coalesce(1)
    h = api.create(spark, str(tmp_path / "ds"), df).spectra()
    assert h.peak_variables() == ["mz", "intensity", "sn", "contributors"]
    got = [[tuple(p) for p in r.peaks] for r in h.peaks_data("contributors", "sn").collect()]
    assert got == [[(3.0, 5.5), (1.0, None)], [(None, float("inf"))], []]
    with pytest.raises(UnsupportedError):
        h.peaks_data("nope")
    with pytest.raises(SemanticError):
        api.create(spark, str(tmp_path / "bad"), df.withColumn("sn", F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))))


def test_partitioning_keeps_order(spark, tmp_path):
    ds = api.create(spark, str(tmp_path / "ds"), large(spark, 60).repartition(3), order_by="place", partitioning=["msLevel"])
    assert any("ms_level=1" in d for d, _, _ in os.walk(ds.path))
    assert [r.totIonCurrent for r in ds.spectra().spectra_data("totIonCurrent").collect()] == [float(i) for i in range(1, 61)]


def test_filters(big):
    h = big.spectra()
    assert h.count() == 3000 and ids(h.filter_ms_level()) == list(range(1, 3001))
    assert ids(h.filter_ms_level(2)) == list(range(2, 3001, 2))
    assert ids(h.filter_rt(10, 12)) == [20, 21, 22, 23, 24] == ids(h.filter_rt(12, 10))
    assert ids(h.filter_rt(1499.5, float("inf"))) == [2999, 3000] and h.filter_rt(float("-inf"), float("inf")) is h
    assert ids(h.filter_rt(10, 11, ms_level=1).filter_rt(10, 12)) == [20, 21, 22, 24]
    assert ids(h.filter_precursor_mz_range(100.2, 100.6)) == [2, 4, 6]
    assert ids(h.filter_precursor_mz_values([100.4, 101.0], ppm=0, tolerance=[0.05, 0.25])) == [4, 8, 10, 12]
    assert ids(h.filter_contains_mz([2501], ppm=0, allow_native=True)) == [25]
    with pytest.raises(UnsupportedError):
        h.filter_contains_mz([1])
    assert h.unique_ms_levels() == [1, 2] and h.filter_ms_level(2).unique_ms_levels() == [2]
    assert ids(h.filter_data_origin("file-b").filter_rt(750, 752)) == [1501, 1502, 1503, 1504]
    both = ids(h.filter_data_origin("file-b", "file-a"))
    assert both == [*range(1501, 3001), *range(1, 1501)]


def test_filter_pushes_down(spark, big):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = big.spectra().filter_rt(10, 12).filter_ms_level(1).spectra_data("spectrum_id_")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(time" in plan and "LessThanOrEqual(time" in plan and "EqualTo(ms_level,1)" in plan
    assert "mz:array" not in plan.split("ReadSchema")[-1]
    plan = big.spectra().filter_data_origin("file-a").ids()._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(run_id" in plan


def test_subsets_and_merge(big):
    h = big.spectra()
    assert ids(h.take([5, 2, 5])) == [6, 3, 6] and ids(h[range(10, 20)]) == list(range(11, 21)) and ids(h.take([0, 7])) == [1, 8]
    some = h.take(range(0, 3000, 2))
    assert ids(some) == list(range(1, 3001, 2)) and ids(some.take([1, 0])) == [3, 1]
    assert ids(h.take(["7", "3"])) == [7, 3]
    assert ids(h.take([5, 2, 5]).filter_ms_level(2)) == [6, 6]
    assert [r.peaks[0].mz for r in h.take([5, 2, 5]).peaks_data().collect()] == [601.0, 301.0, 601.0]
    assert ids(h.take([9, 8]).merge(h.filter_rt(0, 1))) == [10, 9, 1, 2]
    assert h.take([]).count() == 0 and ids(h.take([5]).reset())[:2] == [1, 2]
    with pytest.raises(ReferenceError):
        h.take([3000])


def test_overlay(big):
    h = big.spectra().take([4, 0, 2])
    o = h.with_column("rtime", [7.0, 8.0, 9.0]).with_column("mine", ["x", "y", "z"])
    assert [tuple(r) for r in o.spectra_data("spectrum_id_", "rtime", "mine").collect()] == [(5, 7.0, "x"), (1, 8.0, "y"), (3, 9.0, "z")]
    assert ids(o.filter_rt(8, 9)) == [1, 3] and ids(h.filter_rt(8, 9)) == []
    m = o.merge(big.spectra().take([6]))
    assert [r.mine for r in m.spectra_data("mine").collect()] == ["x", "y", "z", None]
    for name in ("spectrum_id_", "mz", "intensity"):
        with pytest.raises(ReadOnlyError):
            h.with_column(name, [1, 2, 3])
    with pytest.raises(SemanticError):
        h.with_column("x", [1])


def test_accessors(big, tmp_path):
    h = big.spectra().take([1, 0])
    assert [r.tic for r in h.tic().collect()] == [2.0, 1.0]
    assert [r.tic for r in h.tic(initial=False).collect()] == [2001.0 + 2002 + 2003, 1001.0 + 1002]
    assert [r.n_peaks for r in h.lengths().collect()] == [3, 2] and [r.name for r in h.spectra_names().collect()] == ["2", "1"]
    assert [r.mz for r in h.mz().collect()] == [[201.0, 202.0, 203.0], [101.0, 102.0]] and h.smoothed().first()[0] is None
    assert h.data_storage().first()[0] == big.path and len(h.intensity().collect()) == 2 and h.prec_scan_num().count() == 2 and h.centroided().count() == 2
    long = [tuple(r) for r in h.peaks_data("intensity", long=True).collect()]
    assert long == [(2, 0, 2001.0), (2, 1, 2002.0), (2, 2, 2003.0), (1, 0, 1001.0), (1, 1, 1002.0)]
    new = h.with_column("rtime", [5.0, 6.0]).write_to(str(tmp_path / "copy"))
    assert [tuple(r) for r in new.spectra_data("spectrum_id_", "rtime", "totIonCurrent").collect()] == [(1, 5.0, 2.0), (2, 6.0, 1.0)]
    assert ids(pickle.loads(pickle.dumps(big.spectra().filter_rt(10, 11).take([1, 0])))) == [21, 20]
    assert "native" in repr(h)
    assert [r.contains for r in h.contains_mz(102, ppm=1).collect()] == [False, True]
    parts = big.spectra().take(range(4)).split("msLevel")
    assert {k: ids(v) for k, v in parts.items()} == {1: [1, 3], 2: [2, 4]}


def test_samples(spark, tmp_path):
    ds = api.create(spark, str(tmp_path / "ds"), tiny(spark))
    with pytest.raises(CapabilityError):
        ds.spectra().filter_sample_data("timepoint > 1")
    api.set_run_data(ds, spark.createDataFrame([("file-a", "S1", 0, 1.5), ("file-b", "S2", 6, None)], "run_id string, subject string, timepoint int, ratio double"))
    h = ds.spectra()
    assert ids(h.filter_sample_data("timepoint > 1 AND subject = 'S2'")) == [3] and ids(h.filter_sample_data(F.col("ratio") > 1)) == [1, 2]
    assert [tuple(r) for r in h.spectra_data("rtime", "subject").collect()] == [(1.0, "S1"), (2.0, "S1"), (3.0, "S2")]
    assert ds.sample_variables() == ["subject", "timepoint", "ratio"] and api.run_data(ds).count() == 2 and mf.read(ds.path)["generation"] == 2
    with pytest.raises(SemanticError):
        h.filter_sample_data("timepoint")
    for rows, schema, error in (([("nope", 1)], "run_id string, x int", StudyError), ([("file-a", 1), ("file-a", 2)], "run_id string, x int", SemanticError), ([("file-a", 1.0)], "run_id string, rtime double", SemanticError), ([("file-a", 1.0)], "run_id string, ms_level double", SemanticError), ([(1,)], "x int", SemanticError)):
        with pytest.raises(error):
            api.set_run_data(ds, spark.createDataFrame(rows, schema))


def test_cache(big):
    cache.invalidate()
    df = cache.metadata(big)
    assert df.where("rtime BETWEEN 10 AND 12").count() == 5 and cache.metadata(big) is df and cache.warm(big) == 3000
    assert cache.metadata(big, max_cells=10) is not df
    cache.invalidate(big.path)
    assert cache.metadata(big) is not df


def test_cached_handles_agree(big):
    plain, kept = big.spectra(), big.spectra(cached=True)
    assert "mz" not in kept.frame.columns and kept.count() == 3000
    steps = [
        lambda h: h.filter_rt(10, 20).filter_ms_level(2), lambda h: h.filter_rt(10, 11, ms_level=1).filter_rt(0, 30), lambda h: h.filter_precursor_mz_range(100.2, 100.9),
        lambda h: h.filter_data_origin("file-b", "file-a").take([0, 2999]), lambda h: h.take([7, 3, 7]), lambda h: h.filter_contains_mz([2501, 301], ppm=0, allow_native=True),
    ]
    for step in steps:
        a, b = step(plain), step(kept)
        assert ids(a) == ids(b)
        for get in (lambda h: h.peaks_data(), lambda h: h.ion_count(), lambda h: h.lengths(), lambda h: h.spectra_data("rtime", "intensity", "dataOrigin"), lambda h: h.contains_mz(301, ppm=0)):
            assert get(a).collect() == get(b).collect()
    plan = kept.filter_rt(10, 20).spectra_data("spectrum_id_", "rtime")._jdf.queryExecution().toString()
    assert "InMemoryTableScan" in plan
    cache.invalidate(big.path)


# -- archives


def test_ingest(pair):
    h = pair.spectra()
    rows = h.spectra_data("spectrum_id_", "run_id", "msLevel", "rtime", "polarity", "centroided", "precursorMz", "precursorCharge", "isolationWindowLowerMz", "filterString", "scanWindowLowerLimit", "n_scans", "n_precursors", "scanIndex").collect()
    assert len(rows) == 10 and [r.run_id for r in rows] == ["QC01"] * 6 + ["QC02"] * 4
    assert tuple(rows[1]) == (2, "QC01", 2, pytest.approx(2.0), 0, True, 501.0, 2, 500.5, "f1-2", 51.0, 2, 1, 2)
    assert rows[0].precursorMz is None and rows[0].n_precursors is None and rows[6].rtime == pytest.approx(1.0)
    assert [[p.mz for p in r.peaks] for r in h.take([1, 7]).peaks_data().collect()] == [[201.0, 202.0, 203.0, 204.0], [10201.0, 10202.0, 10203.0, 10204.0]]
    assert [r.contains for r in h.take([7, 0]).contains_mz([203, 10203], ppm=1).collect()] == [True, False]
    assert h.peak_variables() == ["mz", "intensity"] and [r.ionCount for r in h.take([0]).ion_count().collect()] == [50.0]
    assert json.load(open(os.path.join(pair.path, "index", "column_map.json")))[0]["accession"] == "MS:1000511"
    assert [r["source"].endswith("mzpeak") for r in mf.run_table(pair.path)] == [True, True]


def test_projection_changes_nothing(pair):
    h = pair.spectra()
    asked = [([203, 10102], 0.0, 0.0), ([300], 500.0, 0.0), ([1e6], 0.0, 5.0)]
    plain = [ids(h.filter_contains_mz(m, tolerance=t, ppm=p)) for m, t, p in asked]
    assert plain == [[2, 7], [1, 2, 3, 4, 5, 6][:6], []] or plain[0] == [2, 7]
    api.build_projection(pair, ["QC01"])
    assert not mf.has_projection(pair.manifest, ["QC01", "QC02"], "mzsorted")
    api.build_projection(pair)
    assert mf.has_projection(pair.manifest, ["QC01", "QC02"], "mzsorted") and os.path.isdir(os.path.join(pair.path, "index", "projections", "mzsorted", "run_id=QC02"))
    assert [ids(h.filter_contains_mz(m, tolerance=t, ppm=p)) for m, t, p in asked] == plain
    assert ids(h.filter_ms_level(1).filter_contains_mz([300], tolerance=500, ppm=0)) == [i for i in plain[1] if i % 2]
    api.drop_projection(pair)
    assert [ids(h.filter_contains_mz(m, tolerance=t, ppm=p)) for m, t, p in asked] == plain
    with pytest.raises(ReferenceError):
        api.build_projection(pair, ["nope"])


def test_drift_zip_and_refusals(spark, tmp_path):
    a = archive(tmp_path, "A.mzpeak", 2, extra={"opt_vendor_flag": [True, False], "level2": pa.array([1, 2], pa.int32())})
    b = archive(tmp_path, "B.mzpeak", 3, extra={"opt_other": pa.array([7, 8, 9], pa.int32()), "level2": pa.array([4.5, 5, 6])}, facets=False)
    z = str(tmp_path / "C.zip")
    c = archive(tmp_path, "C", 1)
    with zipfile.ZipFile(z, "w") as f:
        for name in os.listdir(c):
            f.write(os.path.join(c, name), f"inner/{name}")
    ds = api.create_from_archives(spark, str(tmp_path / "ds"), [a])
    ds = api.add_archives(spark, ds.path, [b, z], link="copy")
    rows = ds.spectra().spectra_data("spectrum_id_", "opt_vendor_flag", "opt_other", "level2", "n_scans").collect()
    assert [tuple(r) for r in rows] == [(1, True, None, 1.0, 2), (2, False, None, 2.0, 2), (3, None, 7, 4.5, None), (4, None, 8, 5.0, None), (5, None, 9, 6.0, None), (6, None, None, None, 2)]
    assert [r.peaks[0].mz for r in ds.spectra().take([5]).peaks_data().collect()] == [101.0]
    with pytest.raises(StudyError):
        api.add_archives(spark, ds.path, [a])
    assert mf.n_spectra(ds.manifest) == 6
    with pytest.raises(UnsupportedError):
        api.add_archives(spark, ds.path, [archive(tmp_path, "D.mzpeak", 1, layout="chunk")])
    with pytest.raises(ArchiveError):
        api.add_archives(spark, ds.path, [str(tmp_path)])
    with pytest.raises(CapabilityError):
        api.open_dataset(spark, ds.path, "profile").peaks_data()
    with zipfile.ZipFile(str(tmp_path / "evil.zip"), "w") as f:
        f.writestr("../out.txt", "x")
    with pytest.raises(ArchiveError):
        api.add_archives(spark, ds.path, [str(tmp_path / "evil.zip")])


# -- mzML


def test_mzml(spark, tmp_path):
    one = mzml(tmp_path / "one.mzML", [(1, 1.0, None, [100.0, 200.5], [1.0, 2.0]), (2, 1.5, 120.5, [50.25], [3.0])])
    two = mzml(tmp_path / "two.mzML.gz", [(1, 2.0, None, [], [])], packed=True)
    h = api.from_mzml(spark, [one, two], str(tmp_path / "ds"))
    rows = h.spectra_data("spectrum_id_", "run_id", "msLevel", "rtime", "precursorMz", "precursorCharge", "collisionEnergy", "activationType", "isolationWindowLowerMz", "precScanNum", "spectrumId", "scanIndex", "centroided", "polarity").collect()
    assert tuple(rows[0]) == (1, "one", 1, 60.0, None, None, None, None, None, None, "scan=1", 0, True, 1)
    assert tuple(rows[1]) == (2, "one", 2, 90.0, 120.5, 2, 27.0, "beam-type collision-induced dissociation", 120.0, 1, "scan=2", 1, True, 1)
    assert rows[2].run_id == "two" and rows[2].rtime == 120.0
    assert [[tuple(p) for p in r.peaks] for r in h.peaks_data().collect()] == [[(100.0, 1.0), (200.5, 2.0)], [(50.25, 3.0)], []]
    with pytest.raises(FormatError):
        api.from_mzml(spark, [one], h.data.path)
    assert api.from_mzml(spark, [one], h.data.path, overwrite=True).count() == 2
    with pytest.raises(FormatError):
        api.from_mzml(spark, [str(tmp_path / "none.mzML")], str(tmp_path / "x"))
    (tmp_path / "a.txt").write_text("")
    with pytest.raises(SemanticError):
        api.from_mzml(spark, [str(tmp_path / "a.txt")], str(tmp_path / "x"))


def test_mzml_is_parsed_once(spark, tmp_path):
    """Each pass over what was parsed leaves a mark; converting leaves one."""
    marks = str(tmp_path / "marks")
    os.makedirs(marks)
    rows = read_mzml(spark, [mzml(tmp_path / "one.mzML", [(1, 1.0 + i, None, [100.0 + i], [1.0]) for i in range(5)])]).drop("file_")
    data = api.create(spark, str(tmp_path / "ds"), rows.mapInArrow(counted(marks), rows.schema))
    assert data.spectra().count() == 5 and len(os.listdir(marks)) == 1


def counted(marks):
    def run(batches):
        import uuid

        some = False
        for b in batches:
            if b.num_rows and not some:
                some = True
                open(os.path.join(marks, uuid.uuid4().hex), "w").close()
            yield b

    return run


def test_ids_of_a_source_in_no_fixed_order(spark, tmp_path):
    """Rows that come in another order each time they are computed are written once."""
    df = large(spark, 600).withColumn("place", F.rand()).repartition(7, F.rand()).drop("place", "dataOrigin")
    data = api.create(spark, str(tmp_path / "ds"), df)
    got = data.spectra().spectra_data("spectrum_id_", "totIonCurrent").collect()
    assert [r.spectrum_id_ for r in got] == list(range(1, 601)) and sorted(r.totIonCurrent for r in got) == [float(i) for i in range(1, 601)]


MZXML = """<?xml version="1.0"?><mzXML xmlns="http://sashimi.sourceforge.net/schema_revision/mzXML_3.2"><msRun scanCount="4"><dataProcessing centroided="1"/>
<scan num="3" msLevel="1" peaksCount="2" polarity="+" retentionTime="PT60S" totIonCurrent="3" lowMz="100"><peaks precision="32" byteOrder="network" contentType="m/z-int" compressionType="none">{a}</peaks>
<scan num="4" msLevel="2" peaksCount="1" polarity="-" retentionTime="PT1M3S" collisionEnergy="27" centroided="0" filterLine="f"><precursorMz precursorScanNum="3" precursorIntensity="5.5" precursorCharge="2">100.5</precursorMz><peaks precision="64" pairOrder="m/z-int" compressionType="zlib">{b}</peaks></scan>
<scan num="5" msLevel="2" peaksCount="0" retentionTime="64"><precursorMz>7.25</precursorMz><peaks precision="32"></peaks></scan></scan>
<scan num="6" peaksCount="0" retentionTime="PT2H"/></msRun></mzXML>"""


def test_mzxml(spark, tmp_path):
    import base64
    import struct
    import zlib

    text = MZXML.format(a=base64.b64encode(struct.pack(">4f", 100.5, 1, 200.25, 2)).decode(), b=base64.b64encode(zlib.compress(struct.pack(">2d", 50.1, 3))).decode())
    (tmp_path / "a.mzXML").write_text(text)
    h = api.from_mzml(spark, [str(tmp_path / "a.mzXML")], str(tmp_path / "ds"))
    rows = [tuple(r) for r in h.spectra_data("acquisitionNum", "msLevel", "rtime", "polarity", "centroided", "precursorMz", "precScanNum", "precursorCharge", "precursorIntensity", "collisionEnergy", "filterString", "totIonCurrent", "lowMZ", "scanIndex").collect()]
    assert rows == [
        (3, 1, 60.0, 1, True, None, None, None, None, None, None, 3.0, 100.0, 0), (4, 2, 63.0, 0, False, 100.5, 3, 2, 5.5, 27.0, "f", None, None, 1),
        (5, 2, 64.0, None, True, 7.25, None, None, None, None, None, None, None, 2), (6, 1, 7200.0, None, True, None, None, None, None, None, None, None, None, 3),
    ]
    assert [[tuple(p) for p in r.peaks] for r in h.peaks_data().collect()] == [[(100.5, 1.0), (200.25, 2.0)], [(50.1, 3.0)], [], []]


def classic(path, record, version=1):
    """A classic netCDF file of two spectra; points in the record dimension or in one of their own."""
    import struct

    def name(x):
        b = x.encode()
        return struct.pack(">i", len(b)) + b + b"\0" * (-len(b) % 4)

    def text(key, x):
        return name(key) + struct.pack(">ii", 2, len(x)) + x.encode() + b"\0" * (-len(x) % 4)

    points = [(100.5, 10), (101.5, 11), (102.5, 12)]
    flat = {"scan_acquisition_time": (6, ">2d", [1.5, 2.5]), "scan_index": (4, ">2i", [0, 2]), "point_count": (4, ">2i", [2, 1]), "total_intensity": (6, ">2d", [21.0, 12.0])}
    variables = list(flat) + ["mass_values", "intensity_values"]
    place = ">q" if version == 2 else ">i"

    def header(at):
        out = b"CDF" + bytes([version]) + struct.pack(">i", 3 if record else 0) + struct.pack(">ii", 10, 2) + name("scan_number") + struct.pack(">i", 2) + name("point_number") + struct.pack(">i", 0 if record else 3)
        out += struct.pack(">ii", 12, 1) + text("test_ionization_polarity", "Negative Polarity") + struct.pack(">ii", 11, len(variables))
        for v in variables:
            kind, size = (flat[v][0], struct.calcsize(flat[v][1])) if v in flat else (5, 4) if v == "mass_values" else (3, 2)
            scale = struct.pack(">ii", 12, 1) + name("scale_factor") + struct.pack(">iid", 6, 1, 2.0) if v == "intensity_values" else struct.pack(">ii", 0, 0)
            vsize = size if v in flat else 4 if record else -(-size * 3 // 4) * 4
            out += name(v) + struct.pack(">ii", 1, 0 if v in flat else 1) + scale + struct.pack(">ii", kind, vsize) + struct.pack(place, at.get(v, 0))
        return out

    at, end = {}, len(header({}))
    for v in variables:
        at[v] = end
        end += struct.calcsize(flat[v][1]) if v in flat else 4 if record else 12 if v == "mass_values" else 8
    body = b"".join(struct.pack(f, *x) for _, f, x in flat.values())
    if record:
        body += b"".join(struct.pack(">fhxx", m, i) for m, i in points)
    else:
        body += struct.pack(">3f", *[m for m, _ in points]) + struct.pack(">3hxx", *[i for _, i in points])
    with open(path, "wb") as f:
        f.write(header(at) + body)
    return str(path)


def test_netcdf(spark, tmp_path):
    made = [classic(tmp_path / "a.cdf", True), classic(tmp_path / "b.nc", False), classic(tmp_path / "c", False, 2)]
    h = api.from_mzml(spark, made, str(tmp_path / "ds"))
    rows = [tuple(r) for r in h.spectra_data("run_id", "msLevel", "rtime", "polarity", "totIonCurrent", "peaksCount").collect()]
    assert rows == [(r, 1, *x) for r in "abc" for x in ((1.5, 0, 21.0, 2), (2.5, 0, 12.0, 1))]
    assert [[tuple(p) for p in r.peaks] for r in h.peaks_data().collect()] == [[(100.5, 20.0), (101.5, 22.0)], [(102.5, 24.0)]] * 3
    (tmp_path / "d.cdf").write_bytes(b"HDF")
    with pytest.raises(Exception, match="no classic netCDF"):
        api.from_mzml(spark, [str(tmp_path / "d.cdf")], str(tmp_path / "x"))


def test_foreign_manifest_and_append(spark, tmp_path):
    ds = api.create(spark, str(tmp_path / "ds"), tiny(spark))
    ds = api.append(ds, tiny(spark).withColumn("more", F.lit(1)))
    assert ds.run_ids == ["file-a", "file-b", "file-a-1", "file-b-1"] and [r["uid_base"] for r in ds.manifest["runs"]] == [1, 3, 4, 6] and ds.manifest["generation"] == 2
    own = json.load(open(os.path.join(ds.path, mf.FILE)))
    os.remove(os.path.join(ds.path, mf.FILE))
    (tmp_path / "ds" / "Other.json").write_text(json.dumps(own | {"format": "Other", "sources": [1]}))
    other = api.append(api.Dataset.open(spark, ds.path), tiny(spark))
    assert ids(other.spectra()) == list(range(1, 10)) and mf.read(ds.path)["sources"] == [1] and not os.path.exists(os.path.join(ds.path, mf.FILE))
    (tmp_path / "ds" / "Second.json").write_text(json.dumps(own))
    with pytest.raises(FormatError):
        api.Dataset.open(spark, ds.path)
    a = archive(tmp_path, "A.mzpeak", 2)
    arc = api.create_from_archives(spark, str(tmp_path / "arc"), [a])
    m = json.load(open(os.path.join(arc.path, mf.FILE)))
    m["runs"][0]["kind"], m["format"] = "points", "Other"
    os.remove(os.path.join(arc.path, mf.FILE))
    (tmp_path / "arc" / "Other.json").write_text(json.dumps(m))
    more = api.add_archives(spark, arc.path, [archive(tmp_path, "B.mzpeak", 3)])
    assert more.kind == "archive" and more.spectra().count() == 5 and {r["kind"] for r in more.manifest["runs"]} == {"points"}


def test_answers_that_were_wrong(spark, big):
    h = big.spectra()
    some = h.filter_ms_level(2)
    for act in (lambda: some.take([0, 1500]), lambda: some.take(["2", "1"]), lambda: h.take(["x"]), lambda: h.take([-1])):
        with pytest.raises(ReferenceError):
            act()
    assert ids(some.take(["4", "2"])) == [4, 2] and len(h.take(range(20)).split("totIonCurrent")) == 20
    parts = [h.take([i]) for i in range(60, 0, -1)]
    merged = parts[0].merge(*parts[1:])
    assert ids(merged) == list(range(61, 1, -1)) and ids(merged.take([59, 0])) == [2, 61] and ids(merged.filter_data_origin("file-b", "file-a").merge(h.take([0]))) == [*range(61, 1, -1), 1]
    from spectrail.sources.dataset import union_by_name

    both = union_by_name([spark.createDataFrame([(16777217,)], "x int"), spark.createDataFrame([(0.5,)], "x float")])
    assert both.dtypes == [("x", "double")] and sorted(r.x for r in both.collect()) == [0.5, 16777217.0]
    windows = [100 + 0.2 * i for i in range(300)]
    few = h.frame.where(" OR ".join(f"precursorMz BETWEEN {w - 0.05} AND {w + 0.05}" for w in windows))
    assert ids(h.filter_precursor_mz_values(windows, ppm=0, tolerance=0.05)) == sorted(r.spectrum_id_ for r in few.select("spectrum_id_").collect())


# -- functions


def test_predicates(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (float("nan"),), (None,)], "x double")
    n = lambda c: df.where(c).count()
    x = F.col("x")
    assert n(pr.in_range(x, 0, 1)) == 2 and n(pr.in_range(x, 0.5, float("inf"))) == 1 and n(pr.in_range(x, float("-inf"), float("inf"))) == 4
    assert n(pr.member(x, [])) == 0 and n(pr.both([])) == 4 and n(pr.either([])) == 0 and n(~pr.surely(pr.member(x, [0.0]))) == 3
    assert pr.windows([100, 200], [10, 20, 30], 1) == [(100 - 1.001, 100 + 1.001), (200 - 1.002, 200 + 1.002)]
    assert pr.exact(0.1) == "0.1D" and pr.exact(None) == "NULL" and pr.quoted("a'b") == "'a\\'b'"
    for low in (59.9999999999, 60.0, 60.00000001):
        t = spark.createDataFrame([(low / 60.0,)], "t double")
        exact = t.where(pr.in_range(F.col("t") * 60.0, low, low + 1)).count()
        assert t.where(pr.widened(F.col("t"), low, low + 1, 60.0) & pr.in_range(F.col("t") * 60.0, low, low + 1)).count() == exact


def test_packing(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [4.0], None), (None, None, None)], "a array<double>, b array<double>, c array<double>")
    got = [r[0] for r in df.select(pk.packed("a", "b", "c")).collect()]
    assert [tuple(x) for x in got[0]] == [(1.0, 4.0, None), (2.0, None, None), (3.0, None, None)] and got[1] == []
    assert [r[0] for r in df.select(pk.summed("b")).collect()] == [4.0, 0.0] and [r[0] for r in df.select(pk.count("a")).collect()] == [3, 0]


def test_translate_absent_columns(spark):
    df = translate(spark.createDataFrame([(1, "r")], "spectrum_id_ int, run_id string"), "/p")
    row = df.first()
    assert row.rtime is None and row.dataStorage == "/p" and dict(df.dtypes)["centroided"] == "boolean" and len(df.columns) >= 30


# -- streaming


def test_arrivals(spark, tmp_path):
    from spectrail.streaming.arrivals import watch

    drop = tmp_path / "drop"
    drop.mkdir()
    archive(drop, "A.mzpeak", 2)
    ds = api.create_from_archives(spark, str(tmp_path / "ds"), [])
    watch(spark, str(drop), ds.path, str(tmp_path / "ck")).awaitTermination()
    archive(drop, "B.mzpeak", 3)
    watch(spark, str(drop), ds.path, str(tmp_path / "ck")).awaitTermination()
    assert [(r["run_id"], r["n_spectra"]) for r in mf.run_table(ds.path)] == [("A", 2), ("B", 3)]
