"""Files of spectra: mzML and mzXML, plain or gzipped, and netCDF. One task a file, spectra streamed in batches."""

from __future__ import annotations

import base64
import gzip
import os
import zlib
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrail.errors import FormatError, SemanticError, UnsupportedError
from spectrail.ship import ship

#: Endings of files that are taken for spectra.
READ = ("mzml", "mzml.gz", "mzxml", "mzxml.gz", "cdf", "nc")
BATCH = 1000

#: PSI-MS terms of dissociation methods, and the one that only supplements another.
DISSOCIATION = {
    "MS:1000133": "collision-induced dissociation", "MS:1000134": "plasma desorption", "MS:1000135": "post-source decay", "MS:1000136": "surface-induced dissociation",
    "MS:1000242": "blackbody infrared radiative dissociation", "MS:1000250": "electron capture dissociation", "MS:1000262": "infrared multiphoton dissociation",
    "MS:1000282": "sustained off-resonance irradiation", "MS:1000422": "beam-type collision-induced dissociation", "MS:1000433": "low-energy collision-induced dissociation",
    "MS:1000435": "photodissociation", "MS:1000598": "electron transfer dissociation", "MS:1000599": "pulsed q dissociation", "MS:1001880": "in-source collision-induced dissociation",
    "MS:1002000": "LIFT", "MS:1002472": "trap-type collision-induced dissociation", "MS:1002481": "higher energy beam-type collision-induced dissociation",
    "MS:1002678": "supplemental beam-type collision-induced dissociation", "MS:1002679": "supplemental collision-induced dissociation",
    "MS:1003246": "ultraviolet photodissociation", "MS:1003247": "negative electron transfer dissociation", "MS:1003294": "electron activated dissociation",
}
SUPPLEMENTAL = frozenset(["MS:1002678", "MS:1002679"])

#: Numpress codings, alone and with zlib; types of numbers.
NUMPRESS = frozenset(["MS:1002312", "MS:1002313", "MS:1002314", "MS:1002746", "MS:1002747", "MS:1002748"])
KINDS = {"MS:1000519": "<i4", "MS:1000521": "<f4", "MS:1000522": "<i8", "MS:1000523": "<f8"}

NUMBERS = {
    "MS:1000285": "totIonCurrent", "MS:1000504": "basePeakMZ", "MS:1000505": "basePeakIntensity", "MS:1000528": "lowMZ", "MS:1000527": "highMZ",
}
SCHEMA = (
    "file_ int, scanIndex int, acquisitionNum int, msLevel int, rtime double, polarity int, centroided boolean, spectrumId string, precScanNum int, precursorMz double, "
    "precursorCharge int, precursorIntensity double, collisionEnergy double, isolationWindowTargetMz double, isolationWindowLowerMz double, isolationWindowUpperMz double, "
    "totIonCurrent double, basePeakMZ double, basePeakIntensity double, lowMZ double, highMZ double, peaksCount int, injectionTime double, filterString string, "
    "scanWindowLowerLimit double, scanWindowUpperLimit double, activationType string, dataOrigin string, mz array<double>, intensity array<double>"
)


def _ending(name: str) -> str:
    low = os.path.basename(name).lower()
    for e in READ:
        if low.endswith("." + e):
            return e
    return "" if "." not in low else low.rsplit(".", 1)[1]


def check_files(files: Sequence[str]) -> None:
    """Files must exist; names without extension are taken for what they begin like."""
    if missing := [f for f in files if not os.path.isfile(f)]:
        raise FormatError(f"no such files: {missing[:5]}", files=missing)
    for f in files:
        if kind_of(f) is None:
            raise SemanticError(f"{f} is no file of spectra", file=f)


def _opened(name: str):
    with open(name, "rb") as f:
        packed = f.read(2) == b"\x1f\x8b"
    return gzip.open(name, "rb") if packed else open(name, "rb")


def kind_of(name: str) -> str | None:
    """mzml, mzxml or cdf: by the ending, without one by the file's beginning."""
    end = _ending(name).removesuffix(".gz").replace("nc", "cdf")
    if end in ("mzml", "mzxml", "cdf"):
        return end
    if end:
        return None
    with _opened(name) as f:
        head = f.read(4096)
    if head[:3] == b"CDF":
        return "cdf"
    return "mzxml" if b"<mzXML" in head else "mzml" if b"<mzML" in head or b"<indexedmzML" in head else None


def _spectra_of(name: str, at: int) -> Iterator[dict]:
    from . import mzxml, netcdf

    if (kind := kind_of(name)) == "cdf":
        yield from netcdf.spectra(name, name, at)
        return
    with _opened(name) as f:
        yield from (mzxml.spectra if kind == "mzxml" else spectra)(f, name, at)


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _terms(node, groups: dict[str, list]) -> list[tuple[str, str, str]]:
    """(term, value, unit) of an element's own parameters, referenced groups in place."""
    out = []
    for c in node:
        kind = _local(c.tag)
        if kind == "cvParam":
            out.append((c.get("accession", ""), c.get("value", ""), c.get("unitName", "")))
        elif kind == "referenceableParamGroupRef":
            out += groups.get(c.get("ref", ""), [])
    return out


def _float(x: str | None) -> float | None:
    try:
        return float(x)
    except (TypeError, ValueError):
        return None


def pick_dissociation(terms: Sequence[str]) -> str | None:
    """The first method that does not only supplement, else the first that does."""
    known = [t for t in terms if t in DISSOCIATION]
    first = next((t for t in known if t not in SUPPLEMENTAL), known[0] if known else None)
    return DISSOCIATION.get(first)


def _binary(node, groups) -> tuple[str | None, np.ndarray]:
    terms = {t for t, _, _ in _terms(node, groups)}
    text = next(((c.text or "") for c in node if _local(c.tag) == "binary"), "")
    raw = base64.b64decode(text)
    if terms & NUMPRESS:
        raise UnsupportedError("numpress arrays can't be read")
    if "MS:1000574" in terms and raw:
        raw = zlib.decompress(raw)
    kind = next((k for t, k in KINDS.items() if t in terms), "<f8")
    which = "mz" if "MS:1000514" in terms else "intensity" if "MS:1000515" in terms else None
    return which, np.frombuffer(raw, kind).astype(float)


def spectra(source, origin: str, file: int = 0) -> Iterator[dict]:
    """The spectra of an open mzML file, one at a time; memory holds one spectrum."""
    groups: dict[str, list] = {}
    number: dict[str, int] = {}
    above: list = []
    for event, node in ElementTree.iterparse(source, events=("start", "end")):
        kind = _local(node.tag)
        if event == "start":
            if kind in ("spectrumList", "chromatogramList", "indexList"):
                above = [node]
            continue
        if kind == "referenceableParamGroup":
            groups[node.get("id", "")] = _terms(node, groups)
        elif kind == "spectrum":
            yield _spectrum(node, groups, origin, file, len(number), number)
        if kind in ("spectrum", "chromatogram", "index"):
            for list_ in above:  # not even an empty element stays
                list_.clear()


def _spectrum(node, groups, origin: str, file: int, index: int, number: dict[str, int]) -> dict:
    out: dict = {"file_": file, "scanIndex": index, "acquisitionNum": index + 1, "spectrumId": node.get("id"), "dataOrigin": origin, "peaksCount": int(node.get("defaultArrayLength") or 0)}
    for part in (out["spectrumId"] or "").split():
        if part.startswith("scan=") and part[5:].isdigit():
            out["acquisitionNum"] = int(part[5:])
    number[out["spectrumId"] or f"#{index}"] = out["acquisitionNum"]
    for t, v, _ in _terms(node, groups):
        if t == "MS:1000511":
            out["msLevel"] = int(v)
        elif t in ("MS:1000130", "MS:1000129"):
            out["polarity"] = int(t == "MS:1000130")
        elif t in ("MS:1000127", "MS:1000128"):
            out["centroided"] = t == "MS:1000127"
        elif t in NUMBERS:
            out[NUMBERS[t]] = _float(v)
    out["mz"], out["intensity"] = [], []
    for x in node.iter():
        kind = _local(x.tag)
        if kind == "scan" and "rtime" not in out:
            for t, v, unit in _terms(x, groups):
                if t == "MS:1000016":
                    out["rtime"] = float(v) * (60.0 if unit == "minute" else 1.0)
                elif t == "MS:1000512":
                    out["filterString"] = v
                elif t == "MS:1000927":
                    out["injectionTime"] = _float(v)
        elif kind == "scanWindow" and "scanWindowLowerLimit" not in out:
            for t, v, _ in _terms(x, groups):
                if t in ("MS:1000501", "MS:1000500"):
                    out["scanWindowLowerLimit" if t == "MS:1000501" else "scanWindowUpperLimit"] = _float(v)
        elif kind == "precursor" and "_precursor" not in out:
            out["_precursor"] = True
            if (ref := x.get("spectrumRef")) in number:
                out["precScanNum"] = number[ref]
            for y in x.iter():
                sub, terms = _local(y.tag), _terms(y, groups)
                values = {t: _float(v) for t, v, _ in terms}
                if sub == "selectedIon" and "precursorMz" not in out:
                    out["precursorMz"], out["precursorIntensity"] = values.get("MS:1000744"), values.get("MS:1000042")
                    out["precursorCharge"] = int(values["MS:1000041"]) if values.get("MS:1000041") is not None else None
                elif sub == "isolationWindow":
                    target = values.get("MS:1000827")
                    out["isolationWindowTargetMz"] = target
                    if target is not None:
                        out["isolationWindowLowerMz"] = target - values["MS:1000828"] if values.get("MS:1000828") is not None else None
                        out["isolationWindowUpperMz"] = target + values["MS:1000829"] if values.get("MS:1000829") is not None else None
                elif sub == "activation":
                    out["collisionEnergy"] = values.get("MS:1000045")
                    out["activationType"] = pick_dissociation([t for t, _, _ in terms])
        elif kind == "binaryDataArray":
            which, data = _binary(x, groups)
            if which:
                out[which] = data
    out.pop("_precursor", None)
    return out


def read_mzml(spark: SparkSession, files: Sequence[str], batch: int = BATCH) -> DataFrame:
    """Variables and peak lists of all spectra of the files; file_ is a file's place, scanIndex a spectrum's place in it."""
    from pyspark.sql.pandas.types import to_arrow_schema

    check_files(files)
    ship(spark)
    empty = spark.createDataFrame([], SCHEMA)
    if not files:
        return empty
    schema = to_arrow_schema(empty.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, name in zip(b.column("at").to_pylist(), b.column("name").to_pylist(), strict=True):
                held: list[dict] = []
                for s in _spectra_of(name, at):
                    held.append(s)
                    if len(held) == batch:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)
                        held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)

    todo = spark.createDataFrame([(i, os.path.abspath(f)) for i, f in enumerate(files)], "at int, name string")
    return todo.repartitionById(len(files), F.col("at")).mapInArrow(run, SCHEMA)
