"""Token ids in flat files.

A data set is a folder with three files for each partition, all little-endian, and nothing else:
    part-NNNNN.u2    the ids of its documents one after another, unsigned 16-bit integers; .u4 and 32 bits if the
                     vocabulary has more than 65,536 ids
    part-NNNNN.off   where each document begins in them, then their number, unsigned 64-bit integers
    part-NNNNN.doc   the doc_ids, signed 64-bit integers (the smallest of all stands for null)
Partitions hold ascending ranges of (doc_id, text hash, place in the table) and are sorted, so the files in order of their names
are one long sequence, and a doc_id or row that many share is dealt over several of them. Where a partition begins in the
sequence follows from the sums of the sizes before it.
"""

from __future__ import annotations

import mmap
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrail.ship import ship

from .common import new_dir, parts_of, ranges
from .tokens import Encoder, kept, kind_for, slices, tokenizer_path, vocabulary_size

END_ID = 0
NULL_DOC = -(2**63)


def _fs(path: str):
    """pyarrow's file system for a path or URI, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class _Writer:
    """Writes one partition under names of its own attempt and renames when it is whole, so a retry can't leave a torn file."""

    def __init__(self, folder: str, part: int, attempt: int, kind: np.dtype) -> None:
        self.fs, top = _fs(folder)
        self.fs.create_dir(top, recursive=True)
        self.width = kind.itemsize
        self.names = [(f"{top}/.part-{part:05d}.{end}.{attempt}", f"{top}/part-{part:05d}.{end}") for end in (f"u{self.width}", "off", "doc")]
        self.ids, self.off, self.doc = (self.fs.open_output_stream(name) for name, _ in self.names)
        self.docs = self.tokens = 0

    def add(self, doc_ids: np.ndarray, ids: list[bytes]) -> None:
        sizes = np.fromiter((len(x) // self.width for x in ids), np.uint64, len(ids))
        starts = np.uint64(self.tokens) + np.concatenate(([0], np.cumsum(sizes)[:-1])).astype("<u8") if len(ids) else sizes
        self.ids.write(b"".join(ids))
        self.off.write(starts.astype("<u8").tobytes())
        self.doc.write(doc_ids.astype("<i8").tobytes())
        self.docs += len(ids)
        self.tokens += int(sizes.sum())

    def close(self) -> None:
        self.off.write(np.array([self.tokens], "<u8").tobytes())
        for stream in (self.ids, self.off, self.doc):
            stream.close()
        for pair in reversed(self.names):
            self.fs.move(*pair)


def write_ids(docs: DataFrame, folder: str, *, path: str | None = None, end_id: int = END_ID, parts: int | None = None) -> list[tuple[int, int, int]]:
    """Writes every document's ids, each document closed by `end_id`, in ascending doc_id order (null first).

    Gives (partition, documents, ids) of the partitions in order; that list, one entry a partition, is all the driver
    gets. Null and empty texts have the end id alone. Rows that repeat a doc_id are kept, ordered by a hash of the text.
    An empty table gives no files; other columns are left behind. Without `parts` there is one for each 128 MB of input, and
    at least spark.sql.shuffle.partitions.
    """
    path = path or tokenizer_path()
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    parts = parts or parts_of(rows)
    rows = rows.withColumn("at", F.struct(F.col("doc_id").alias("k"), F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("i")))
    cuts, place = ranges(rows, "doc_id", "at", parts)
    rows = rows.withColumn("part", place).repartitionById(cuts + 1, F.col("part"))
    rows = rows.sortWithinPartitions("part", "at").select("doc_id", "text", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, writer, part = kept(Encoder, path), None, None
        end = np.array([end_id], encoder.kind).tobytes()
        for batch in batches:
            if writer is None and batch.num_rows:
                part = batch.column("part")[0].as_py()
                writer = _Writer(folder, part, TaskContext.get().taskAttemptId(), encoder.kind)
            for some, texts in slices(batch):
                ids = some.column("doc_id").fill_null(NULL_DOC).to_numpy(zero_copy_only=False)
                writer.add(ids, [x + end for x in encoder.encode(texts)])
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([writer.docs], pa.int64()), pa.array([writer.tokens], pa.int64())], ["part", "docs", "tokens"])

    done = rows.mapInArrow(run, "part int, docs long, tokens long").collect()
    return sorted((r.part, r.docs, r.tokens) for r in done)


def _open(name: str):
    """The file mapped into memory; a store that can't be mapped is read."""
    fs, path = _fs(name)
    from pyarrow.fs import LocalFileSystem

    if isinstance(fs, LocalFileSystem):
        if not os.path.getsize(path):
            return b""
        with open(path, "rb") as f:
            return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    return fs.open_input_file(path).readall()


def read_ids(spark: SparkSession, folder: str, found: list[tuple[int, int, int]], *, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of 32-bit ids) of every document of the files, and its ids if asked for.

    `found` is what write_ids gave; an empty list gives an empty result. Repeated rows each give a row. A file is mapped, or read
    where its store can't be mapped, by one task.
    """
    kind = np.dtype(kind_for(vocabulary_size(path or tokenizer_path())))
    ship(spark)
    bases, base = [], 0
    for part, _, tokens in found:
        bases.append((part, base))
        base += tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, first in zip(*(batch.column(c).to_pylist() for c in ("part", "base")), strict=True):
                name = f"{folder}/part-{part:05d}"
                ids, off, doc = (_open(f"{name}.{end}") for end in (f"u{kind.itemsize}", "off", "doc"))
                offsets, docs, ids = np.frombuffer(off, "<u8").astype(np.int64), np.frombuffer(doc, "<i8"), np.frombuffer(ids, kind)
                for at in range(0, len(docs), 5000):
                    cut = offsets[at : at + 5001]
                    spans = [ids[a:b].astype("<u4") for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                    which = docs[at : at + 5000]
                    columns = [pa.array(which, mask=which == NULL_DOC), pa.array(cut[:-1] + first), pa.array(np.diff(cut)), pa.array([zlib.crc32(s) for s in spans], pa.int64())]
                    if with_ids:
                        columns.append(pa.array([s.astype(np.int64) for s in spans], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    if not bases:
        return spark.createDataFrame([], schema)
    # One task a file: the rows are numbered and dealt by that number.
    todo = spark.createDataFrame([(i, *x) for i, x in enumerate(bases)], "n int, part int, base long").repartitionById(len(bases), F.col("n"))
    return todo.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    folder = new_dir(spark, "token-ids")
    found = write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    return read_ids(spark, folder, found)
