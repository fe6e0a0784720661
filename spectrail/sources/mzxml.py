"""mzXML files: scans, nested or not, in the order in which they begin."""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np

from spectrail.errors import UnsupportedError

#: Attributes of a scan that are numbers of the same meaning.
NUMBERS = {"lowMz": "lowMZ", "highMz": "highMZ", "basePeakMz": "basePeakMZ", "basePeakIntensity": "basePeakIntensity", "totIonCurrent": "totIonCurrent", "collisionEnergy": "collisionEnergy", "startMz": "scanWindowLowerLimit", "endMz": "scanWindowUpperLimit"}
DURATION = re.compile(r"P(?:T(?:(\d+(?:\.\d+)?)H)?(?:(\d+(?:\.\d+)?)M)?(?:(\d+(?:\.\d+)?)S)?)?$")


def seconds(text: str | None) -> float | None:
    """A duration such as PT1M2.5S, or plain seconds."""
    if not text:
        return None
    m = DURATION.match(text)
    if m is None:
        return float(text)
    return sum(float(x) * n for x, n in zip(m.groups(), (3600.0, 60.0, 1.0), strict=True) if x)


def _peaks(node) -> tuple[np.ndarray, np.ndarray]:
    if (node.get("contentType") or node.get("pairOrder") or "m/z-int") != "m/z-int":
        raise UnsupportedError("peaks must be pairs of m/z and intensity", content=node.get("contentType"))
    raw = base64.b64decode(node.text or "")
    if node.get("compressionType") == "zlib" and raw:
        raw = zlib.decompress(raw)
    pairs = np.frombuffer(raw, ">f8" if node.get("precision") == "64" else ">f4").astype(float)
    return pairs[0::2], pairs[1::2]


def spectra(source, origin: str, file: int = 0) -> Iterator[dict]:
    """The scans of an open mzXML file. A scan is whole when it ends or another begins in it; memory holds the open ones."""
    open_: list[dict | None] = []
    given, index, run = False, 0, None
    for event, node in ElementTree.iterparse(source, events=("start", "end")):
        kind = node.tag.rsplit("}", 1)[-1]
        if event == "start":
            if kind == "dataProcessing":
                given = node.get("centroided") == "1"
            if kind == "msRun":
                run = node
            if kind != "scan":
                continue
            if open_ and open_[-1] is not None:  # what a scan says of itself stands before the scans in it
                yield open_[-1]
                open_[-1] = None
            number = int(node.get("num") or index + 1)
            out = {"file_": file, "scanIndex": index, "acquisitionNum": number, "spectrumId": f"scan={number}", "dataOrigin": origin, "msLevel": int(node.get("msLevel") or 1), "peaksCount": int(node.get("peaksCount") or 0), "rtime": seconds(node.get("retentionTime")), "mz": [], "intensity": []}
            out |= {name: float(node.get(a)) for a, name in NUMBERS.items() if node.get(a)}
            if node.get("polarity") in ("+", "-"):
                out["polarity"] = int(node.get("polarity") == "+")
            out["centroided"] = node.get("centroided") == "1" if node.get("centroided") is not None else given
            if node.get("filterLine"):
                out["filterString"] = node.get("filterLine")
            open_.append(out)
            index += 1
        elif kind == "precursorMz" and open_ and open_[-1] is not None and "precursorMz" not in open_[-1]:
            own = open_[-1]
            own["precursorMz"] = float(node.text) if node.text else None
            for a, name, make in (("precursorIntensity", "precursorIntensity", float), ("precursorCharge", "precursorCharge", int), ("precursorScanNum", "precScanNum", int)):
                if node.get(a):
                    own[name] = make(node.get(a))
        elif kind == "peaks" and open_ and open_[-1] is not None:
            open_[-1]["mz"], open_[-1]["intensity"] = _peaks(node)
        elif kind == "scan":
            if (last := open_.pop()) is not None:
                yield last
            if not open_ and run is not None:  # not even an empty element stays
                run.clear()
        if event == "end" and kind in ("scan", "peaks", "offset"):
            node.clear()
