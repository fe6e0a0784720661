"""netCDF files of the mass spectrometry exchange format: classic files (versions 1 and 2), mapped into memory."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

from spectrail.errors import FormatError

#: The external types by their number.
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}


class Classic:
    """dims: sizes (0: the record dimension, n its size); attributes: of the file; variables: name -> (dims, attributes, type, bytes a record, place)."""

    def __init__(self, name: str) -> None:
        self.data = np.memmap(name, np.uint8, "r")
        head = bytes(self.data[:4])
        if head[:3] != b"CDF" or head[3] not in (1, 2):
            raise FormatError(f"{name} is no classic netCDF file", file=name)
        self.at, self.wide = 4, head[3] == 2
        self.n = self._int()
        self.dims = [(self._name(), self._int()) for _ in range(self._list())]
        self.attributes = self._attributes()
        self.variables = {}
        for _ in range(self._list()):
            name = self._name()
            dims = [self._int() for _ in range(self._int())]
            own = self._attributes()
            kind, size = self._int(), self._int()
            begin = self._int(8) if self.wide else self._int()
            self.variables[name] = (dims, own, TYPES[kind], size, begin)

    def _int(self, width: int = 4) -> int:
        self.at += width
        return struct.unpack(">q" if width == 8 else ">i", bytes(self.data[self.at - width : self.at]))[0]

    def _list(self) -> int:
        self._int()
        return self._int()

    def _text(self, n: int) -> bytes:
        raw = bytes(self.data[self.at : self.at + n])
        self.at += -(-n // 4) * 4
        return raw

    def _name(self) -> str:
        return self._text(self._int()).decode()

    def _attributes(self) -> dict:
        out = {}
        for _ in range(self._list()):
            name, kind, n = self._name(), self._int(), self._int()
            raw = self._text(n * np.dtype(TYPES[kind]).itemsize)
            out[name] = raw.decode(errors="replace").rstrip("\0") if kind == 2 else np.frombuffer(raw, TYPES[kind]).tolist()
        return out

    def get(self, name: str) -> np.ndarray | None:
        """A variable's values, scaled if it says so; None if there is none of that name."""
        if name not in self.variables:
            return None
        dims, own, kind, size, begin = self.variables[name]
        kind, sizes = np.dtype(kind), [self.dims[d][1] for d in dims]
        if sizes and sizes[0] == 0:  # a record of each such variable stands beside those of the others
            records = [v for v in self.variables.values() if v[0] and self.dims[v[0][0]][1] == 0]
            step = sum(v[3] for v in records) if len(records) > 1 else int(np.prod(sizes[1:], dtype=np.int64)) * kind.itemsize
            shape, strides = (self.n, *sizes[1:]), (step, *[int(np.prod(sizes[i + 1 :], dtype=np.int64)) * kind.itemsize for i in range(1, len(sizes))])
            out = np.ndarray(shape, kind, self.data, begin, strides)
        else:
            out = np.ndarray(sizes, kind, self.data, begin)
        if "scale_factor" in own or "add_offset" in own:
            return out * float(own.get("scale_factor", [1])[0]) + float(own.get("add_offset", [0])[0])
        return out


def spectra(name: str, origin: str, file: int = 0) -> Iterator[dict]:
    """The spectra of a file, all of level 1; their points are read one spectrum at a time."""
    f = Classic(name)
    begin, count, mz, intensity = (f.get(v) for v in ("scan_index", "point_count", "mass_values", "intensity_values"))
    if begin is None or mz is None or intensity is None:
        raise FormatError(f"{name} lacks scan_index, mass_values or intensity_values", file=name)
    if count is None:
        count = np.diff(np.append(begin, len(mz)))
    time, total, low, high = (f.get(v) for v in ("scan_acquisition_time", "total_intensity", "mass_range_min", "mass_range_max"))
    polarity = {"positive": 1, "negative": 0}.get(str(f.attributes.get("test_ionization_polarity", "")).split(" ")[0].lower())
    value = lambda x, i: None if x is None else float(x[i])
    for i in range(len(begin)):
        a, b = int(begin[i]), int(begin[i]) + int(count[i])
        yield {
            "file_": file, "scanIndex": i, "acquisitionNum": i + 1, "spectrumId": f"scan={i + 1}", "dataOrigin": origin, "msLevel": 1, "peaksCount": b - a, "polarity": polarity, "rtime": value(time, i),
            "totIonCurrent": value(total, i), "lowMZ": value(low, i), "highMZ": value(high, i), "mz": np.asarray(mz[a:b], float), "intensity": np.asarray(intensity[a:b], float),
        }
