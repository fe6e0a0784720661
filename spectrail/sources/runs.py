"""Run ids and blocks of spectrum ids, on the driver."""

from __future__ import annotations

import os
import re
from bisect import bisect_right

from spectrail.errors import ReferenceError, SemanticError

VALID = re.compile(r"(?![._])[A-Za-z0-9._-]+$")


def sanitised(text: str) -> str:
    """Letters, digits, dot, underscore and dash; other runs of characters become an underscore; none of dot and underscore leads; never empty."""
    out = re.sub(r"[^A-Za-z0-9._-]+", "_", text)
    out = re.sub(r"^[._]+", "", out)
    return out or "run"


def of_file(name: str) -> str:
    """The run id of a file: its base name without extension (and .gz)."""
    base = os.path.basename(name.replace("\\", "/"))
    base = re.sub(r"\.gz$", "", base, flags=re.IGNORECASE)
    return sanitised(re.sub(r"\.[^.]*$", "", base) or base)


def unique(ids: list[str], held: list[str] = ()) -> list[str]:
    """The ids with -1, -2, ... behind those that came before, or are `held` already, regardless of case."""
    taken, out = {i.lower() for i in ids}, []
    used: set[str] = {i.lower() for i in held}
    for i in ids:
        new, n = i, 0
        while new.lower() in used or (n and new.lower() in taken):
            n += 1
            new = f"{i}-{n}"
        used.add(new.lower())
        out.append(new)
    return out


def check_ids(ids: list[str]) -> None:
    for i in ids:
        if i is None or not VALID.match(i):
            raise SemanticError(f"{i!r} is not a valid run id", run_id=i)
    low = [i.lower() for i in ids]
    if len(set(low)) != len(low):
        raise SemanticError("run ids must differ by more than case", run_ids=ids)


def run_of(manifest: dict, spectrum_ids: list[int]) -> list[str]:
    """The run of each id; ids outside all blocks are an error."""
    runs = sorted(manifest["runs"], key=lambda r: r["uid_base"])
    bases = [r["uid_base"] for r in runs]
    out, outside = [], []
    for i in spectrum_ids:
        at = bisect_right(bases, i) - 1
        if at < 0 or i >= bases[at] + runs[at]["n_spectra"]:
            outside.append(i)
        else:
            out.append(runs[at]["run_id"])
    if outside:
        raise ReferenceError(f"no run holds the ids {outside[:5]}", ids=outside)
    return out


def id_ranges(manifest: dict, run_ids: set[str]) -> list[tuple[int, int]]:
    """The runs' ids as ranges, both ends included; blocks that touch are one range."""
    out: list[tuple[int, int]] = []
    for r in sorted(manifest["runs"], key=lambda r: r["uid_base"]):
        if r["run_id"] in run_ids:
            a, b = r["uid_base"], r["uid_base"] + r["n_spectra"] - 1
            if out and out[-1][1] + 1 == a:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
    return out


def run_column(blocks: list[tuple[str, int, int]], spectrum_id):
    """The run of an id column, null outside all blocks. blocks: (run id, first id, number), few enough for the driver."""
    from pyspark.sql import functions as F

    blocks = sorted(blocks, key=lambda b: b[1])
    if not blocks:
        return F.lit(None).cast("string")
    begins = F.array(*[F.lit(b).cast("long") for _, b, _ in blocks])
    at = F.size(F.filter(begins, lambda b: b <= spectrum_id)) - 1
    end = F.get(F.array(*[F.lit(b + n).cast("long") for _, b, n in blocks]), at)
    return F.when(spectrum_id < end, F.get(F.array(*[F.lit(r) for r, _, _ in blocks]), at))
