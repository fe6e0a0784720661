"""Small inputs whose values are functions of the row, so that any wrong join or order shows."""

import base64
import gzip
import json
import os
import struct
import zlib

import pyarrow as pa
import pyarrow.parquet as pq

TINY = "msLevel int, rtime double, precursorMz double, dataOrigin string, totIonCurrent double, mz array<double>, intensity array<double>"


def tiny(spark):
    rows = [(1, 1.0, None, "file-a", 30.0, [100.0, 110.0], [10.0, 20.0]), (1, 2.0, None, "file-a", 32.0, [101.0, 111.0], [11.0, 21.0]), (2, 3.0, 110.5, "file-b", 34.0, [102.0, 112.0], [12.0, 22.0])]
    return spark.createDataFrame(rows, TINY).coalesce(1)


def large(spark, n=3000):
    rows = []
    for i in range(1, n + 1):
        k = i % 3 + 1
        rows.append((1 + (i + 1) % 2, i * 0.5, 100 + i / 10 if i % 2 == 0 else None, "file-a" if i <= n // 2 else "file-b", float(i), [i * 100.0 + j for j in range(1, k + 1)], [i * 1000.0 + j for j in range(1, k + 1)], i))
    return spark.createDataFrame(rows, TINY + ", place int")


def archive(folder, name, n, run_id=None, offset=0.0, centroid=True, npeaks=4, extra=None, layout="point", facets=True):
    """A directory archive of n spectra, levels 1 and 2 in turn."""
    path = os.path.join(folder, name)
    os.makedirs(path)
    idx = list(range(n))
    meta = {
        "index": pa.array(idx, pa.int32()), "id": [f"scan={i + 1}" for i in idx], "ms_level": pa.array([1 + i % 2 for i in idx], pa.int32()), "time": [(i + 1) / 60 for i in idx],
        "scan_polarity": pa.array([1 if i % 2 == 0 else -1 for i in idx], pa.int32()), "spectrum_representation": ["MS:1000127" if centroid else "MS:1000128"] * n,
        "total_ion_current": [float(i) for i in idx], "number_of_data_points": pa.array([npeaks] * n, pa.int32()),
    } | (extra or {})
    pq.write_table(pa.table(meta), f"{path}/a.parquet")
    files = [{"name": "a.parquet", "entity_type": "Spectrum", "data_kind": "metadata", "column_mapping": [{"path": "ms_level", "name": "ms level", "accession": "MS:1000511", "unit": None}]}]
    if facets:
        scans = {"source_index": pa.array([i for i in idx for _ in range(2)], pa.int32()), "scan_index": pa.array([2 * i + 1 - j for i in idx for j in range(2)], pa.int32()), "filter_string": [f"f{i}-{2 * i + 1 - j}" for i in idx for j in range(2)], "scan_windows": [[{"scan_window_lower_limit": 50.0 + i, "scan_window_upper_limit": 500.0 + i}] for i in idx for _ in range(2)]}
        pq.write_table(pa.table(scans), f"{path}/b.parquet")
        two = [i for i in idx if i % 2]
        pq.write_table(pa.table({"source_index": pa.array(two, pa.int32()), "selected_ion_mz": [500.0 + i for i in two], "charge_state": pa.array([2] * len(two), pa.int32())}), f"{path}/c.parquet")
        pq.write_table(pa.table({"source_index": pa.array(two, pa.int32()), "precursor_index": pa.array([i - 1 for i in two], pa.int32()), "isolation_window": [{"isolation_window_target": 500.0 + i, "isolation_window_lower_offset": 0.5, "isolation_window_upper_offset": 1.0} for i in two]}), f"{path}/d.parquet")
        files += [{"name": f, "entity_type": "spectrum", "data_kind": k} for f, k in (("b.parquet", "scans"), ("c.parquet", "selected ions"), ("d.parquet", "precursors"))]
    point = pa.array([{"spectrum_index": i, "mz": 100.0 * (i + 1) + j + offset, "intensity": 10.0 * (i + 1) + j} for i in idx for j in range(npeaks, 0, -1)], pa.struct([("spectrum_index", pa.int32()), ("mz", pa.float64()), ("intensity", pa.float64())]))
    arrays = {"prefix": layout, "entries": [{"path": "point.mz", "array_type": "MS:1000514", "buffer_priority": "primary"}, {"path": "point.intensity", "array_type": "MS:1000515", "buffer_priority": "primary"}]}
    table = pa.table({"point": point}).replace_schema_metadata({"spectrum_array_index": json.dumps(arrays)})
    pq.write_table(table, f"{path}/s.parquet")
    files.append({"name": "s.parquet", "entity_type": "spectrum", "data_kind": "peaks" if centroid else "data arrays"})
    with open(f"{path}/mzpeak_index.json", "w") as f:
        json.dump({"files": files, "metadata": {"version": "1"} | ({"run": {"id": run_id}} if run_id else {})}, f)
    return path


def mzml(path, spectra, packed=False):
    """spectra: (level, rt in minutes, precursor or None, mz, intensity)."""
    def array(values, term):
        raw = base64.b64encode(zlib.compress(struct.pack(f"<{len(values)}d", *values))).decode()
        return f'<binaryDataArray><cvParam accession="MS:1000523" name="64-bit float"/><cvParam accession="MS:1000574" name="zlib compression"/><cvParam accession="{term}"/><binary>{raw}</binary></binaryDataArray>'

    body = []
    for i, (level, rt, precursor, mz, intensity) in enumerate(spectra):
        p = "" if precursor is None else f'<precursorList><precursor spectrumRef="scan={i}"><isolationWindow><cvParam accession="MS:1000827" value="{precursor}"/><cvParam accession="MS:1000828" value="0.5"/></isolationWindow><selectedIonList><selectedIon><cvParam accession="MS:1000744" value="{precursor}"/><cvParam accession="MS:1000041" value="2"/></selectedIon></selectedIonList><activation><cvParam accession="MS:1002678"/><referenceableParamGroupRef ref="act"/><cvParam accession="MS:1000045" value="27"/></activation></precursor></precursorList>'
        body.append(f'<spectrum index="{i}" id="scan={i + 1}" defaultArrayLength="{len(mz)}"><cvParam accession="MS:1000511" value="{level}"/><cvParam accession="MS:1000130"/><cvParam accession="MS:1000127"/><scanList><scan><cvParam accession="MS:1000016" value="{rt}" unitName="minute"/></scan></scanList>{p}<binaryDataArrayList>{array(mz, "MS:1000514")}{array(intensity, "MS:1000515")}</binaryDataArrayList></spectrum>')
    text = f'<?xml version="1.0"?><mzML xmlns="http://psi.hupo.org/ms/mzml"><referenceableParamGroupList><referenceableParamGroup id="act"><cvParam accession="MS:1000422"/></referenceableParamGroup></referenceableParamGroupList><run><spectrumList>{"".join(body)}</spectrumList></run></mzML>'
    with (gzip.open if packed else open)(path, "wb") as f:
        f.write(text.encode())
    return str(path)
