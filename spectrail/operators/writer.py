"""Writing a native dataset: spectra with their peaks as lists, one directory a run, the manifest last."""

from __future__ import annotations

import os
import shutil
import uuid
import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from spectrail.errors import FormatError, SemanticError
from spectrail.functions.vocab import BY_NAME, PEAKS, encode, written_name
from spectrail.sources import manifest as mf
from spectrail.sources import runs as rn

ROW_GROUP = 250


def cut_runs(df: DataFrame) -> list[tuple[str, str | None, int]]:
    """(run id, origin, number of spectra) of a frame with position, in order.

    A run_id column decides, if there is one: each id must be one stretch. Else stretches of one data origin are runs,
    if every origin is one stretch and none is missing; otherwise all is one run. One grouped pass: a value is one
    stretch if no other value's first and last positions lie between its own.
    """
    by = "run_id" if "run_id" in df.columns else "dataOrigin" if "dataOrigin" in df.columns else None
    if by is None:
        return [("native", None, n)] if (n := df.count()) else []
    found = df.groupBy(by).agg(F.min("position").alias("a"), F.max("position").alias("b"), F.count("*").alias("n")).orderBy("a").collect()
    whole = all(r.b - r.a + 1 == r.n for r in found)
    if by == "run_id":
        ids = [r[by] for r in found]
        rn.check_ids(ids)
        if not whole:
            raise SemanticError("the spectra of a run_id must stand together", run_ids=[r[by] for r in found if r.b - r.a + 1 != r.n][:5])
        return [(i, None, r.n) for i, r in zip(ids, found, strict=True)]
    if not found:
        return []
    if not whole or any(not r[by] for r in found):
        return [("native", None, sum(r.n for r in found))]
    ids = rn.unique([rn.of_file(r[by]) for r in found])
    return [(i, r[by], r.n) for i, r in zip(ids, found, strict=True)]


def drop_empty(df: DataFrame) -> DataFrame:
    """Without the variables of the vocabulary that are null throughout; other columns stay."""
    return df.drop(*_facts(df)[0])


def _facts(df: DataFrame) -> tuple[list[str], list[str]]:
    """Variables of the vocabulary that are null throughout, and lists that are not as long as mz; one pass."""
    core = [c for c in df.columns if c in BY_NAME]
    lists = [f.name for f in df.schema.fields if isinstance(f.dataType, ArrayType) and f.name != "mz"] if "mz" in df.columns else []
    n = F.size(F.coalesce(F.col("mz"), F.array().cast("array<double>"))) if lists else None
    wrong = [F.max((F.col(f"`{c}`").isNotNull() & (F.size(F.col(f"`{c}`")) != n)).cast("int")).alias(f"wrong_{i}") for i, c in enumerate(lists)]
    if not core and not wrong:
        return [], []
    row = df.agg(*[F.count(F.col(c)).alias(f"full_{i}") for i, c in enumerate(core)], *wrong).first()
    return [c for i, c in enumerate(core) if not row[f"full_{i}"]], [c for i, c in enumerate(lists) if row[f"wrong_{i}"]]


def staged(df: DataFrame, folder: str, order_by: str | None) -> DataFrame:
    """`df`, written once below `folder`, with position: a row's place from 0 in the order of order_by, or of partitions and rows.

    A file holds a range of that order, so a place is the row's number in its file behind the counts of the files before it;
    the driver sees a count for each file. Whatever the source does when it is read again, places stay what they are.
    """
    if order_by is not None:
        df = df.repartitionByRange(F.col(order_by).asc_nulls_first()).sortWithinPartitions(F.col(order_by).asc_nulls_first()).drop(order_by)
    df.write.parquet(folder)
    spark = df.sparkSession
    read = spark.read.schema(df.schema).parquet(folder)
    files = read.groupBy(F.col("_metadata.file_name").alias("name")).agg(F.count("*").alias("n")).collect()
    base, bases = 0, []
    for r in sorted(files, key=lambda r: int(r.name.split("-")[1])):
        bases.append((r.name, base))
        base += r.n
    if not bases:
        return read.withColumn("position", F.lit(0).cast("long"))
    rows = read.select("*", F.col("_metadata.file_name").alias("_name"), F.col("_metadata.row_index").alias("_row"))
    begin = F.broadcast(spark.createDataFrame(bases, "_name string, _base long"))  # a row a file
    return rows.join(begin, "_name").withColumn("position", F.col("_base") + F.col("_row")).drop("_name", "_row", "_base")


def _write_runs(df: DataFrame, path: str, manifest: dict, *, order_by: str | None, keys: list[str], compression: str, row_group: int) -> dict:
    """Writes a frame's spectra as runs behind those of the manifest, below spectra/; gives the manifest with them."""
    for c in PEAKS:
        if c not in df.columns or not isinstance(df.schema[c].dataType, ArrayType):
            raise SemanticError(f"column {c!r} must be a list for each spectrum", column=c)
    if missing := [k for k in keys if k not in df.columns]:
        raise SemanticError(f"no columns to partition by: {missing}", columns=missing)
    df = df.drop("spectrum_id_", "spectrum_index", "dataStorage", "_time", "ord_")
    os.makedirs(path, exist_ok=True)
    staging = os.path.join(path, f".staging-{uuid.uuid4().hex}")
    try:
        df = staged(df, f"file://{os.path.abspath(staging)}/rows", order_by)
        empty, wrong = _facts(df)
        if wrong:
            raise SemanticError(f"lists differ in length from mz: {wrong}", columns=wrong)
        df = df.drop(*empty)
        found = cut_runs(df)
        keys = [k for k in keys if k not in empty]
        if "dataOrigin" in keys and found and all(o is not None for _, o, _ in found):
            warnings.warn("runs are the data origins; dataOrigin is not needed as a partition key", stacklevel=4)
            keys.remove("dataOrigin")
        ids = rn.unique([r for r, _, _ in found], [r["run_id"] for r in manifest["runs"]])
        first, base, begins = mf.next_base(manifest), 0, []
        for run, (_, origin, n) in zip(ids, found, strict=True):
            begins.append(base)
            manifest = mf.add_run(manifest, run, "native", f"spectra/run_id={run}", n, {"layout": "list", "profile": None, "centroid": None, "partitioning": keys, "source": origin})
            base += n
        if not found:
            os.makedirs(os.path.join(path, "spectra"), exist_ok=True)
            return manifest
        # A row's run by its place among the beginnings.
        at = F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in begins]), lambda b: b <= F.col("position"))) - 1
        start = F.get(F.array(*[F.lit(b).cast("long") for b in begins]), at)
        rows = df.drop("run_id").withColumn("run_id", F.get(F.array(*[F.lit(r) for r in ids]), at))
        rows = rows.withColumn("spectrum_id_", (F.col("position") + first).cast("int")).withColumn("spectrum_index", F.col("position") - start)
        on_disk = [written_name(k) for k in keys]
        out = encode(rows.drop("position")).sortWithinPartitions("run_id", *on_disk, "spectrum_id_").write.partitionBy("run_id", *on_disk)
        out.option("compression", compression).option("parquet.block.row.count.limit", row_group).parquet(f"file://{os.path.abspath(staging)}/spectra")
        written = df.sparkSession.read.schema("spectrum_id_ int").parquet(f"file://{os.path.abspath(staging)}/spectra").count()
        if written != base:
            raise FormatError(f"{written} spectra were written, {base} were announced", written=written, announced=base)
        os.makedirs(os.path.join(path, "spectra"), exist_ok=True)
        for run in ids:
            os.rename(os.path.join(staging, "spectra", f"run_id={run}"), os.path.join(path, "spectra", f"run_id={run}"))
        return manifest
    finally:
        shutil.rmtree(staging, ignore_errors=True)


def write_native(df: DataFrame, path: str, *, order_by: str | None = None, partitioning: Sequence[str] = (), compression: str = "snappy", row_group: int = ROW_GROUP, extra: dict | None = None) -> None:
    """Writes a frame of variables and peak lists as a new dataset. The frame is computed once.

    order_by: a column, unique, by which the spectra are ordered (it is not written); without one the order is
    that of the frame's partitions and rows. Ids are the places in that order, from 1. Runs lie in it one after another.
    """
    if os.path.exists(path) and os.listdir(path):
        raise FormatError(f"{path} is not empty", path=path)
    manifest = _write_runs(df, path, mf.new() | (extra or {}), order_by=order_by, keys=list(partitioning), compression=compression, row_group=row_group)
    mf.write(path, manifest)


def append_native(df: DataFrame, path: str, *, order_by: str | None = None, compression: str = "snappy", row_group: int = ROW_GROUP) -> None:
    """Adds a frame's spectra as new runs behind those of a native dataset, with its partition keys; ids go on. Columns may differ.

    Run ids that are taken get a suffix. Nothing counts before the manifest is replaced.
    """
    with mf.locked(path):
        manifest = mf.read(path)
        if mf.kind_of(manifest) != "native":
            raise FormatError(f"{path} holds archives", path=path)
        keys = next((list(r["signal"].get("partitioning") or []) for r in manifest["runs"]), [])
        mf.write(path, _write_runs(df, path, manifest, order_by=order_by, keys=keys, compression=compression, row_group=row_group), lock=False)
