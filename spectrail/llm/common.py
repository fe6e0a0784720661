"""What the corpus operators share: table access, materialisation in the shared folder, joins with hot keys."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrail.functions.order import cuts_of, place_among

#: Above this many rows a small side is no longer broadcast; the join is shuffled instead.
BROADCAST_ROWS = 200_000

_created: list[tuple[object, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table of the input folder, cut to `columns` if any are given."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir; in local mode one of our own where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spectrail-")
        spark.sparkContext.setCheckpointDir(found)
        _drop_at_exit(spark, found)
    # A path without a scheme belongs to the cluster's default file system.
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(found)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


def new_dir(spark: SparkSession, label: str) -> str:
    """A fresh name below the shared folder; removed when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _drop_at_exit(spark, path)
    return path


def _drop_at_exit(spark: SparkSession, path: str) -> None:
    if not _created:
        atexit.register(_drop_all)
    _created.append((spark, path))


def _drop_all() -> None:
    for spark, path in _created:
        drop(spark, path)


def drop(spark: SparkSession, path: str) -> None:
    """Removes a folder through Hadoop's file systems; one that is gone, or a session that has ended, is no error."""
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the JVM is gone
        pass


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes `df` as Parquet into the shared folder and reads it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small(df: DataFrame, rows: int) -> DataFrame:
    """`df` marked for broadcast if its counted `rows` stay within BROADCAST_ROWS; else as it is."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, each with underscores in front until no column of `taken` has it, whatever its case."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


def parts_of(df: DataFrame, size: int = 128 << 20, most: int = 20_000) -> int:
    """Into how many parts of about `size` bytes the plan's estimate of `df` goes; at least spark.sql.shuffle.partitions."""
    held = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(partitions(df.sparkSession), min(most, held // size))


def spread_join(big: DataFrame, rows: int, few: DataFrame, key: str, n: str) -> DataFrame:
    """`big` (of `rows` rows) joined by `key` with `few`, which has a row for each key and in `n` how many rows of big have it.

    Keys that hold more than a quarter of an even share of a task are joined by broadcast: by their size at most
    4 x spark.sql.shuffle.partitions of them. The rest, now without hot keys, are shuffled. The column `n` is dropped.
    """
    share = max(1, rows // (4 * partitions(big.sparkSession)))
    hot = F.broadcast(few.where(F.col(n) > share).drop(n))
    rest = big.join(F.broadcast(hot.select(key)), key, "left_anti").join(few.where(F.col(n) <= share).drop(n), key)
    return big.join(hot, key).unionByName(rest)


def ranges(rows: DataFrame, key: str, at: str, parts: int) -> tuple[int, Column]:
    """How many cuts deal the rows into about `parts` even ranges, and each row's range, from 0, in the order of column `at`.

    `at` is a struct that begins with the key and makes every row different. The keys alone are looked at first, as they are cheap to
    read; where some are so frequent that no `parts` different cuts are found, the whole structs are.
    """
    for c in (key, at):
        cuts = cuts_of(rows.select(c), c, parts)
        if c == at or len(cuts) == parts - 1:
            return len(cuts), place_among(F.col(c), cuts, rows.schema[c].dataType)
