"""The two vocabularies of spectrum metadata: variables as users know them, columns as they are on disk."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectrail.errors import SemanticError

PEAKS = ("mz", "intensity")
#: Columns that keep their name and are always carried.
KEYS = ("spectrum_id_", "run_id", "spectrum_index", "n_scans", "n_selected_ions", "n_precursors")
#: Terms of the PSI-MS vocabulary for a spectrum's representation.
CENTROID, PROFILE = "MS:1000127", "MS:1000128"


@dataclass(frozen=True)
class Variable:
    """name and type of a variable; sources: on-disk columns, the first whose all parts exist is read; read: how."""

    name: str
    type: str
    sources: tuple[tuple[str, ...], ...]
    read: object = None

    def column(self, available: set[str]) -> Column:
        for parts in self.sources:
            if all(p in available for p in parts):
                value = self.read(*[F.col(f"`{p}`") for p in parts]) if self.read else F.col(f"`{parts[0]}`")
                return value.cast(self.type).alias(self.name)
        return F.lit(None).cast(self.type).alias(self.name)


def _same(name: str, column: str, kind: str) -> Variable:
    return Variable(name, kind, ((column,),))


VARIABLES = (
    _same("msLevel", "ms_level", "int"),
    Variable("rtime", "double", (("time",),), lambda t: t * F.lit(60.0)),
    Variable("polarity", "int", (("scan_polarity",),), lambda p: F.when(p == 1, 1).when(p == -1, 0)),
    Variable("centroided", "boolean", (("spectrum_representation",),), lambda r: F.when(r == CENTROID, True).when(r == PROFILE, False)),
    _same("spectrumId", "id", "string"),
    Variable("acquisitionNum", "int", (("acquisition_num_",), ("spectrum_index",))),
    Variable("scanIndex", "int", (("scan_index",), ("spectrum_index",))),
    _same("precScanNum", "precursor_index", "int"),
    _same("precursorMz", "selected_ion_mz", "double"),
    _same("precursorCharge", "charge_state", "int"),
    _same("precursorIntensity", "peak_intensity", "double"),
    _same("collisionEnergy", "collision_energy", "double"),
    _same("isolationWindowTargetMz", "isolation_window_target", "double"),
    Variable("isolationWindowLowerMz", "double", (("isolation_window_target", "isolation_window_lower_offset"),), lambda t, o: t - o),
    Variable("isolationWindowUpperMz", "double", (("isolation_window_target", "isolation_window_upper_offset"),), lambda t, o: t + o),
    _same("totIonCurrent", "total_ion_current", "double"),
    _same("basePeakMZ", "base_peak_mz", "double"),
    _same("basePeakIntensity", "base_peak_intensity", "double"),
    _same("lowMZ", "lowest_observed_mz", "double"),
    _same("highMZ", "highest_observed_mz", "double"),
    Variable("peaksCount", "int", (("number_of_peaks", "number_of_data_points"), ("number_of_peaks",), ("number_of_data_points",)), lambda *c: F.coalesce(*c)),
    _same("injectionTime", "ion_injection_time", "double"),
    _same("filterString", "filter_string", "string"),
    _same("scanWindowLowerLimit", "scan_window_lower_limit", "double"),
    _same("scanWindowUpperLimit", "scan_window_upper_limit", "double"),
    _same("instrumentConfigurationId", "instrument_configuration_id", "int"),
    _same("spectrumType", "spectrum_type", "string"),
    _same("activationType", "activation_type", "string"),
    _same("dataOrigin", "data_origin", "string"),
)
BY_NAME = {v.name: v for v in VARIABLES}
CONSUMED = frozenset(p for v in VARIABLES for parts in v.sources for p in parts) - set(KEYS)

#: On-disk column of each variable, and how it is written.
WRITTEN = {v.name: v.sources[0][0] for v in VARIABLES} | {"peaksCount": "number_of_data_points"}
ENCODE = {
    "rtime": lambda c: c / F.lit(60.0),
    "polarity": lambda c: F.when(c == 1, 1).when(c == 0, -1),
    "centroided": lambda c: F.when(c, CENTROID).when(~c, PROFILE),
}


def translate(raw: DataFrame, storage: str | None = None) -> DataFrame:
    """The variables of a frame with on-disk columns, in one projection.

    All variables of the vocabulary appear, as typed nulls without a source; other columns pass. The columns that range
    predicates push down to are kept under a leading underscore.
    """
    available = set(raw.columns)
    keys = [F.col(k) for k in KEYS if k in available]
    core = [v.column(available) for v in VARIABLES]
    where = F.lit(storage).cast("string").alias("dataStorage")
    rest = [F.col(f"`{c}`") for c in raw.columns if c not in KEYS and c not in CONSUMED]
    pushed = [F.col("time").alias("_time")] if "time" in available else []
    return raw.select(*keys, *core, where, *rest, *pushed)


def check_names(names: list[str]) -> None:
    """Names must differ by more than case, from each other and from the vocabulary's."""
    seen: dict[str, str] = {}
    for n in names:
        if (other := seen.setdefault(n.lower(), n)) != n:
            raise SemanticError(f"columns {other!r} and {n!r} differ only by case", columns=[other, n])
    for n in names:
        known = next((v for v in (*BY_NAME, *KEYS, *PEAKS) if v.lower() == n.lower() and v != n), None)
        if known:
            raise SemanticError(f"column {n!r} differs only by case from {known!r}", columns=[n, known])


def encode(df: DataFrame) -> DataFrame:
    """The frame with on-disk columns: the inverse of `translate`. Isolation bounds become offsets from their target."""
    check_names(df.columns)
    out: list[Column] = []
    has_target = "isolationWindowTargetMz" in df.columns
    for name in df.columns:
        c = F.col(f"`{name}`")
        if name in ("dataStorage", "run_id", "_time"):
            continue
        if name == "isolationWindowLowerMz":
            if has_target:
                out.append((F.col("isolationWindowTargetMz") - c).alias("isolation_window_lower_offset"))
        elif name == "isolationWindowUpperMz":
            if has_target:
                out.append((c - F.col("isolationWindowTargetMz")).alias("isolation_window_upper_offset"))
        elif name in WRITTEN:
            out.append((ENCODE[name](c) if name in ENCODE else c).alias(WRITTEN[name]))
        else:
            out.append(c)
    kept = [c for c in ("run_id",) if c in df.columns]
    return df.select(*kept, *out)


def written_name(variable: str) -> str:
    return WRITTEN.get(variable, variable)
