"""The manifest: one small JSON file that makes a directory a dataset. All on the driver.

{format, version, generation, created, runs: [...]}; other top-level keys are kept as they are. A run owns the ids
uid_base .. uid_base + n_spectra - 1; runs tile 1..N without gaps. The file is replaced atomically, last of all writes.

A dataset that another engine made, of the same layout under a manifest of its own name, is read and extended as it is: the manifest
is the one JSON file on top that has these keys, and its format, version and names of kinds are kept. Only `native` is a fixed name
there; any other kind is an archive.
"""

from __future__ import annotations

import copy
import json
import os
import re
from datetime import datetime, timezone

from spectrail.errors import CapabilityError, ConflictError, FormatError, ReferenceError, StaleError, StudyError

FILE, LOCK = "dataset.json", ".dataset.lock"
FORMAT, VERSION = "spectrail-dataset", "0.1.0"
KINDS = ("native", "archive")
PROJECTIONS = ("mzsorted",)

_cache: dict[str, tuple[tuple[int, int], dict]] = {}


KEYS = {"format", "version", "generation", "runs"}


def manifest_path(path: str) -> str:
    """The manifest's file: our own, or the one JSON file of its form."""
    own = os.path.join(path, FILE)
    if os.path.isfile(own) or not os.path.isdir(path):
        return own
    found = [f for f in sorted(os.listdir(path)) if f.endswith(".json") and _has_form(os.path.join(path, f))]
    return os.path.join(path, found[0]) if len(found) == 1 else own


def _has_form(name: str) -> bool:
    try:
        with open(name, encoding="utf-8") as f:
            found = json.load(f)
    except (OSError, ValueError):
        return False
    return isinstance(found, dict) and found.keys() >= KEYS


def is_dataset(path: str) -> bool:
    return os.path.isfile(manifest_path(path))


def stamp(path: str) -> tuple:
    """Changes whenever the manifest does."""
    st = os.stat(manifest_path(path))
    return st.st_mtime_ns, st.st_size, st.st_ino


def new() -> dict:
    return {"format": FORMAT, "version": VERSION, "generation": 1, "created": datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"), "runs": []}


def major(version: object) -> int:
    m = re.match(r"(\d+)\.\d+\.\d+$", str(version))
    if not m:
        raise FormatError(f"{version!r} is not a semantic version", version=version)
    return int(m[1])


def read(path: str) -> dict:
    """The manifest of a dataset, fresh from disk."""
    name = manifest_path(path)
    if not os.path.isfile(name):
        raise FormatError(f"{path} is not a dataset: it has no {FILE}", path=path)
    try:
        with open(name, encoding="utf-8") as f:
            found = json.load(f)
    except ValueError as e:
        raise FormatError(f"{name} is not valid JSON: {e}", path=path) from e
    if not isinstance(found, dict) or not isinstance(found.get("format"), str) or (os.path.basename(name) == FILE and found["format"] != FORMAT):
        raise FormatError(f"{name} has format {found.get('format') if isinstance(found, dict) else None!r}, not {FORMAT!r}", path=path)
    if major(found.get("version")) != major(VERSION):
        raise FormatError(f"{name} has version {found['version']}; this engine reads {VERSION}", path=path, version=found["version"])
    if not isinstance(found.get("generation"), int) or not isinstance(found.get("runs"), list):
        raise FormatError(f"{name} lacks a generation or runs", path=path)
    kinds = {r["kind"] for r in found["runs"]}
    if len(kinds) > 1 or (found["format"] == FORMAT and not kinds <= set(KINDS)):
        raise FormatError(f"{name} mixes or has unknown kinds of runs: {sorted(kinds)}", path=path)
    for r in found["runs"]:
        r["signal"], r["projections"] = r.get("signal") or {}, r.get("projections") or {}
        if not os.path.isabs(r["path"]) and r["kind"] != "native":
            r["path"] = os.path.join(path, r["path"])
    return found


def load(path: str) -> dict:
    """The manifest, cached by the file's time and size."""
    try:
        now = stamp(path)
    except FileNotFoundError:
        return read(path)
    held = _cache.get(path)
    if held is None or held[0] != now:
        _cache[path] = held = (now, read(path))
    return copy.deepcopy(held[1])


def forget(path: str | None = None) -> None:
    _cache.clear() if path is None else _cache.pop(path, None)


class locked:
    """Holds a dataset's lock, a directory that only one process can make."""

    def __init__(self, path: str) -> None:
        self.name = os.path.join(path, LOCK)

    def __enter__(self) -> None:
        try:
            os.mkdir(self.name)
        except FileExistsError as e:
            raise ConflictError(f"another writer holds {self.name}", lock=self.name) from e

    def __exit__(self, *_) -> None:
        os.rmdir(self.name)


def write(path: str, manifest: dict, *, bump: bool = True, lock: bool = True) -> dict:
    """Replaces the manifest if the one on disk is still of the generation that `manifest` came from."""
    if not manifest.keys() >= KEYS or (not is_dataset(path) and manifest["format"] != FORMAT):
        raise FormatError("not a manifest", path=path)
    if lock:
        with locked(path):
            return write(path, manifest, bump=bump, lock=False)
    manifest = copy.deepcopy(manifest)
    if is_dataset(path):
        now = read(path)["generation"]
        if now != manifest["generation"]:
            raise StaleError(f"{path} is at generation {now}; this manifest is of {manifest['generation']}", expected=manifest["generation"], found=now)
        manifest["generation"] += int(bump)
    name = manifest_path(path)
    with open(f"{name}.tmp", "w", encoding="utf-8") as f:
        json.dump(manifest, f, ensure_ascii=False, indent=2)
        f.flush()
        os.fsync(f.fileno())
    os.replace(f"{name}.tmp", name)
    forget(path)
    return manifest


def kind_of(manifest: dict) -> str:
    """native or archive; a dataset without runs is taken for native."""
    return "archive" if manifest["runs"] and manifest["runs"][0]["kind"] != "native" else "native"


def run_table(path: str) -> list[dict]:
    """The runs, flat."""
    out = []
    for r in load(path)["runs"]:
        signal = r.get("signal", {})
        out.append({
            "run_id": r["run_id"], "kind": r["kind"], "path": r["path"], "n_spectra": r["n_spectra"], "uid_base": r["uid_base"], "ingested_at": r["ingested_at"],
            "layout": signal.get("layout"), "profile": signal.get("profile"), "centroid": signal.get("centroid"), "source": signal.get("source") or (r["path"] if r["kind"] != "native" else None),
        })
    return out


def n_spectra(manifest: dict) -> int:
    return sum(r["n_spectra"] for r in manifest["runs"])


def next_base(manifest: dict) -> int:
    return max((r["uid_base"] + r["n_spectra"] for r in manifest["runs"]), default=1)


def add_run(manifest: dict, run_id: str, kind: str, path: str, n: int, signal: dict) -> dict:
    """The manifest with one more run behind the others. Ids must differ by more than case."""
    if n < 1:
        raise FormatError(f"run {run_id!r} has no spectra", run_id=run_id)
    if any(r["run_id"].lower() == run_id.lower() for r in manifest["runs"]):
        raise StudyError(f"run {run_id!r} is in the dataset already", run_id=run_id)
    manifest = copy.deepcopy(manifest)
    if kind == "archive" and manifest["runs"]:
        kind = manifest["runs"][0]["kind"]  # by the name that the dataset has for it
    manifest["runs"].append({"run_id": run_id, "kind": kind, "path": path, "n_spectra": n, "uid_base": next_base(manifest), "ingested_at": manifest["generation"], "signal": signal, "projections": {}})
    return manifest


def set_projection(manifest: dict, run_id: str, kind: str, **more) -> None:
    for r in manifest["runs"]:
        if r["run_id"] == run_id:
            r["projections"][kind] = {"generation": r["ingested_at"], **more}
            return
    raise ReferenceError(f"no run {run_id!r}", run_id=run_id)


def drop_projection(manifest: dict, run_id: str, kind: str) -> None:
    for r in manifest["runs"]:
        if r["run_id"] == run_id:
            r["projections"].pop(kind, None)


def has_projection(manifest: dict, run_ids: list[str], kind: str, **more) -> bool:
    """Whether all the runs have it, built from their present data (and with the given properties)."""
    by_id = {r["run_id"]: r for r in manifest["runs"]}
    for i in run_ids:
        p = by_id.get(i, {}).get("projections", {}).get(kind)
        if not p or p["generation"] != by_id[i]["ingested_at"] or any(p.get(k) != v for k, v in more.items()):
            return False
    return bool(run_ids)


def check_projection(kind: str) -> None:
    if kind not in PROJECTIONS:
        raise CapabilityError(f"unknown projection {kind!r}", kind=kind)
