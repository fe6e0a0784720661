"""Benchmark decontamination with an FM-index for each training shard.

A shard is a run of documents of one partition. Only runs of words that all occur in the benchmark and are as long as
its shortest window can hold an occurrence, so the index holds those runs alone, between separators; that loses none.
All windows are searched backwards at once, occurrences are located by sampled suffix positions, and overlapping spans
are merged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrail.ship import ship

from .common import fresh, materialize, small
from .fm_index import FmIndex
from .tokens import slices

WINDOW = 10
#: Benchmark words whose windows go to the executors at once; a larger benchmark, or a longer item, is searched in several blocks.
BLOCK_WORDS = 500_000
#: A shard is indexed when it holds this many documents or this many words of the benchmark.
SHARD_DOCS, SHARD_WORDS = 20_000, 2_000_000

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: A-Z become a-z; every other byte but digits, a-z and those of non-ASCII characters becomes a space.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x20 if b < 0x30 or 0x39 < b < 0x61 or 0x7A < b < 0x80 else b for b in range(256))


def words(text: str) -> list[bytes]:
    return text.encode().translate(FOLD).split()


def _null_last(item: str | None) -> tuple[bool, str]:
    return item is None, item or ""


class Windows:
    """The different windows of some benchmark items as word numbers, by length, and the items that have each.

    groups: (length, windows, where each window's items begin in owners, owners); owners are places in names.
    """

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW) -> None:
        self.number: dict[bytes, int] = {}
        self.names = sorted({item for item, _ in items}, key=_null_last)
        place = {item: i for i, item in enumerate(self.names)}
        found: dict[int, tuple[list[np.ndarray], list[np.ndarray]]] = {}
        for item, w in items:
            if w:
                n = min(window, len(w))
                ids = np.array([self.number.setdefault(x, len(self.number) + 1) for x in w], np.int32)
                cut = np.lib.stride_tricks.sliding_window_view(ids, n)
                rows, owners = found.setdefault(n, ([], []))
                rows.append(cut)
                owners.append(np.full(len(cut), place[item], np.int32))
        self.shortest = min(found, default=0)
        self.groups = []
        for n in sorted(found):
            rows, which = np.unique(np.concatenate(found[n][0]), axis=0, return_inverse=True)
            pairs = np.unique(np.stack([which.ravel(), np.concatenate(found[n][1])], 1), axis=0)
            self.groups.append((n, rows, np.searchsorted(pairs[:, 0], np.arange(len(rows) + 1)), pairs[:, 1].astype(np.int32)))


def _blocks(benchmark: DataFrame, window: int, size: int) -> Iterator[Windows]:
    """The items in blocks of about `size` words; a longer item is cut into pieces that share window - 1 words. At least one block, though it be empty."""
    held, used, first = [], 0, True
    step = max(1, size - window + 1)
    for row in benchmark.select(F.col("item_id").cast("string").alias("i"), F.coalesce("text", F.lit("")).alias("t")).toLocalIterator():
        w = words(row.t)
        for at in range(0, max(1, len(w) - window + 1), step):
            held.append((row.i, w[at : at + step + window - 1]))
            used += len(held[-1][1])
            if used >= size:
                yield Windows(held, window)
                held, used, first = [], 0, False
    if held or first:
        yield Windows(held, window)


class _Shard:
    def __init__(self, windows: Windows) -> None:
        self.w = windows
        self.counts: list[np.ndarray] = []
        self.docs = self.held = 0
        self.segments: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, texts: list[str]) -> None:
        get, n = self.w.number.get, np.zeros(len(texts), np.int64)
        ids = []
        for i, text in enumerate(texts):
            w = words(text)
            n[i] = len(w)
            ids.append(np.fromiter(map(get, w, repeat(0)), np.int32, len(w)))
            ids.append(np.zeros(1, np.int32))
        if self.w.shortest:
            seq = np.concatenate([np.zeros(1, np.int32), *ids])
            inside = (seq > 0).astype(np.int8)
            edge = np.diff(inside)
            begin, end = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
            long = end - begin >= self.w.shortest
            begin, end = begin[long], end[long]
            base = np.concatenate(([0], np.cumsum(n + 1)))[:-1] + 1
            doc = np.searchsorted(base, begin, side="right") - 1
            size = end - begin
            flat = seq[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)]
            self.segments.append((doc + self.docs, begin - base[doc], size, flat))
            self.held += int(size.sum())
        self.counts.append(n)
        self.docs += len(texts)

    def full(self) -> bool:
        return self.docs >= SHARD_DOCS or self.held >= SHARD_WORDS

    def finish(self) -> tuple[np.ndarray, dict[int, tuple[list[tuple[int, int]], list[str | None]]]]:
        """Words of each document, and of those with a hit the merged spans and the items."""
        counts = np.concatenate(self.counts) if self.counts else np.zeros(0, np.int64)
        hits: dict[int, tuple[list[tuple[int, int]], list[str | None]]] = {}
        if self.held:
            doc, word, size, flat = (np.concatenate(x) for x in zip(*self.segments, strict=True))
            place = np.cumsum(size + 1) - size  # of each segment in the sequence, behind its separator
            seq = np.zeros(int(size.sum()) + len(size) + 1, np.int64)
            seq[np.repeat(place, size) + np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
            index = FmIndex(seq, len(self.w.number) + 1)
            spans, pairs = [], set()
            for n, patterns, of, owners in self.w.groups:
                row, low, high = index.search(patterns)
                which, at = index.locate(low, high)
                segment = np.searchsorted(place, at, side="right") - 1
                where = doc[segment]
                begin = word[segment] + at - place[segment]
                spans.append(np.stack([where, begin, begin + n], 1))
                for d, r in np.unique(np.stack([where, row[which]], 1), axis=0).tolist() if len(at) else ():
                    pairs.update((d, i) for i in owners[of[r] : of[r + 1]].tolist())
            for d, begin, end in np.unique(np.concatenate(spans), axis=0).tolist():
                own = hits.setdefault(d, ([], []))[0]
                if own and begin <= own[-1][1]:
                    own[-1] = (own[-1][0], max(end, own[-1][1]))
                else:
                    own.append((begin, end))
            for d, i in sorted(pairs):
                hits[d][1].append(self.w.names[i])
        return counts, hits


SPANS = "array<struct<start:long,end:long>>"
RESULT = f"doc_id long, mark long, n_words long, n_hit long, spans {SPANS}, items array<string>"


def _search(rows: DataFrame, windows: Windows) -> DataFrame:
    ship(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(windows)
    kind = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, keys = _Shard(shared.value), []

        def out():
            counts, hits = shard.finish()
            ids, marks = (pa.concat_arrays([k[i] for k in keys]) for i in (0, 1))
            spans = [[{"start": a, "end": b} for a, b in hits[i][0]] if i in hits else [] for i in range(len(counts))]
            n_hit = [sum(s["end"] - s["start"] for s in x) for x in spans]
            return pa.RecordBatch.from_arrays([ids, marks, pa.array(counts), pa.array(n_hit, pa.int64()), pa.array(spans, kind.field("spans").type), pa.array([hits[i][1] if i in hits else [] for i in range(len(counts))], pa.list_(pa.string()))], schema=kind)

        for batch in batches:
            for part, texts in slices(batch):
                shard.add(texts)
                keys.append((part.column("doc_id"), part.column("mark")))
                if shard.full():
                    yield out()
                    shard, keys = _Shard(shared.value), []
        if keys:
            yield out()

    return rows.select("doc_id", "mark", "text").mapInArrow(run, RESULT)


def merge_spans(spans):
    """Overlapping or touching spans of a sorted array made one, as a column."""
    empty = F.array().cast(SPANS)
    last = lambda a: F.element_at(a, -1)
    joined = lambda a, s: F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct(last(a)["start"].alias("start"), F.greatest(last(a)["end"], s["end"]).alias("end"))))
    return F.aggregate(spans, empty, lambda a, s: F.when((F.size(a) > 0) & (s["start"] <= F.try_element_at(a, F.lit(-1))["end"]), joined(a, s)).otherwise(F.concat(a, F.array(s))))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """`leaks` without the mark, and contaminated (n_hit > 0)."""
    found = leaks(docs, benchmark, **how)
    return found.select("doc_id", "n_words", "n_hit", "spans", "items", (F.col("n_hit") > 0).alias("contaminated"))


def leaks(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, mark (xxhash64 of the text), n_words, n_hit, spans (in words, end exclusive, merged) and items of every document.

    docs: doc_id, text; benchmark: item_id, text. Null and empty texts have no words; items without words have no
    windows; an item shorter than the window is one window. One null at the end of items stands for all found items without
    id. Repeated rows each give a row, empty tables none; other columns are left behind. The windows of a block of the benchmark are
    broadcast, about `block_words` of them; a larger benchmark is searched block by block and the blocks' spans are merged by document.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("mark"), "text")
    blocks = _blocks(benchmark, window, block_words)
    first, second = next(blocks), next(blocks, None)
    found = _search(rows, first)
    if second is not None:
        found = materialize(found, "leaks")
        hits = found.where("n_hit > 0")
        while second is not None:
            hits = hits.unionByName(materialize(_search(rows, second).where("n_hit > 0"), "leaks-more"))
            second = next(blocks, None)
        # A text's hits: at most a row for each block and copy of the row.
        hits = hits.dropDuplicates(["doc_id", "mark", "spans", "items"]).groupBy("doc_id", "mark").agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        hits = hits.select(F.col("doc_id").alias("d"), F.col("mark").alias("m"), merge_spans(F.col("spans")).alias("s"), F.col("items").alias("i"))
        found = found.select("doc_id", "mark", "n_words").join(hits, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")), "left")
        found = found.select("doc_id", "mark", "n_words", F.coalesce("s", F.array().cast(SPANS)).alias("spans"), F.coalesce("i", F.array().cast("array<string>")).alias("items"))
        found = found.withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]))
    return found.select("doc_id", "mark", "n_words", "n_hit", "spans", "items")


def remove_spans(docs: DataFrame, found: DataFrame) -> DataFrame:
    """`docs` with the words of `leaks`' spans, and what stands between them, cut out of their texts; null texts stay null.

    Only documents with spans travel to Python; the others are joined by (doc_id, text) to nothing and pass as they are.
    """
    d, m, spans = fresh(docs.columns, "hit_doc", "hit_mark", "hit_spans")
    hit = found.where("n_hit > 0").select(F.col("doc_id").alias(d), F.col("mark").alias(m), F.col("spans").alias(spans)).dropDuplicates([d, m])
    hit = materialize(hit, "spans")
    same = docs["doc_id"].cast("long").eqNullSafe(F.col(d)) & (F.xxhash64(docs["text"]) == F.col(m))
    rows = docs.join(small(hit, hit.count()), same, "left")

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([without(t, [(s["start"], s["end"]) for s in own]) for t, own in zip(text, spans, strict=True)])

    ship(docs.sparkSession)
    clean = rows.where(F.col(spans).isNull()).select(*docs.columns)
    dirty = rows.where(F.col(spans).isNotNull()).withColumn("text", cut("text", spans)).select(*docs.columns)
    return clean.unionByName(dirty)


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    places = [m.span() for m in WORDS.finditer(text)]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return "".join([*out, text[at:]])


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (
  SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT item_id, least(len(w), 10) AS n, unnest(list_transform(range(1, greatest(len(w) - 10, 0) + 2), lambda i: array_to_string(w[i:i + 9], ' '))) AS k FROM item WHERE len(w) > 0),
lengths AS (SELECT DISTINCT n FROM win),
grams AS (
  SELECT r, n, unnest(range(1, len(w) - n + 2)) AS i, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS k
  FROM doc CROSS JOIN lengths WHERE len(w) >= n),
occ AS (SELECT g.r, g.i, g.n, v.item_id FROM grams g JOIN win v ON g.k = v.k AND g.n = v.n),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM occ)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT r, item_id FROM occ) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""
