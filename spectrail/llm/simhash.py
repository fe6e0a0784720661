"""SimHash near-duplicates, found by a hierarchical index in Gray order.

Fingerprints are sorted by Gray rank into a tree whose upper nodes hold the masked bit patterns that all below them share; a
search adds up differences from these on the way down and drops whole groups (see gray_index). The tree is cut at its top so
that tasks can work on parts of it: its first level are a few bits, taken at most + 1 places, which a pair within `most` bits
must share at one of them. How many bits follows from the number of different fingerprints, so that a part holds about PART of
them at every size, and every part, small or large, is searched by its own tree. A part too large for one task is cut into runs by
a hash, and each pair of runs is searched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectrail.ship import ship

from .common import materialize, partitions, small, spread_join
from .components import components
from .gray_index import linked
from .tokens import slices

WORDS = 4
MOST = 4
SEED = 42
#: Fingerprints of a part, on average, and the most that a task indexes at once.
PART, NODE = 16_384, 65_536


def fingerprint(text: str, words: int = WORDS) -> int:
    """The SimHash of a text's shingles, as an unsigned integer; 0 for a text without words."""
    import xxhash

    digest = xxhash.xxh64_digest
    found = text.encode().lower().split()
    if not found:
        return 0
    if len(found) < words:
        return int.from_bytes(digest(b" ".join(found), SEED), "big")
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n, ones = len(found) - words + 1, np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        a, b = starts[at : min(at + 65536, n)].tolist(), ends[at + words - 1 : min(at + 65536, n) + words - 1].tolist()
        raw = b"".join([digest(joined[i:j], SEED) for i, j in zip(a, b, strict=True)])
        ones += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = WORDS, *, marks: bool = False) -> DataFrame:
    """doc_id and print (the fingerprint's bits as a signed long) of every row; with `marks` also mark (xxhash64 of the text)."""
    names = ["doc_id", "mark"] if marks else ["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                prints = np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(prints)], [*names, "print"])

    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("mark"), "text").select(*names, "text")
    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in [*names, "print"]))


def masks(n: int, most: int = MOST, part: int = PART) -> list[int]:
    """Bit masks such that any two of `n` words within `most` bits agree on one of them, and one value of a mask is shared by `part` words or fewer, if these are spread evenly.

    The words are cut into most + r blocks, from which r are taken each time: whichever bits differ, r blocks are free of
    them. r is the least that gives enough bits; up to `part` words need none, and are one part.
    """
    bits = max(0, math.ceil(math.log2(max(1, n) / part)))
    if not bits:
        return [0]
    chosen = next(r for r in range(1, 65) if r * (64 // (most + r)) >= bits or r == 60)
    width = min(64 // (most + chosen), math.ceil(bits / chosen))
    blocks = [((1 << width) - 1) << (i * (64 // (most + chosen))) for i in range(most + chosen)]
    return [sum(c) for c in combinations(blocks, chosen)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def links(prints: DataFrame, n: int, most: int = MOST, node: int = NODE, part: int = PART) -> DataFrame:
    """(child, parent) edges that join the `n` different fingerprints of column print into their groups."""
    spark = prints.sparkSession
    ship(spark)
    under = [F.struct(F.lit(i).alias("mask"), F.col("print").bitwiseAND(F.lit(_signed(m))).alias("pattern")) for i, m in enumerate(masks(n, most, part))]
    dealt = prints.select("print", F.explode(F.array(*under)).alias("node")).select("node.*", "print")
    dealt = dealt.withColumns({"part": F.lit(0), "other": F.lit(0), "side": F.lit(0)})
    large = dealt.groupBy("mask", "pattern").agg(F.count("*").alias("rows")).where(F.col("rows") > node)
    large = materialize(large, "large-nodes")
    if many := large.count():
        # Runs of such a part by a hash of the fingerprint; each pair of runs is dealt to a task of its own.
        large = large.select(F.col("mask").alias("m"), F.col("pattern").alias("p"), F.ceil(F.col("rows") * 2.0 / node).cast("int").alias("runs"))
        both = dealt.join(small(large, many), (F.col("mask") == F.col("m")) & (F.col("pattern") == F.col("p")), "left").drop("m", "p", "part", "other", "side")
        run = F.pmod(F.xxhash64("print"), F.col("runs")).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), F.col("runs") - 1), lambda i: F.struct(F.least(i, run).alias("part"), F.greatest(i, run).alias("other"), (i < run).cast("int").alias("side")))
        alone = F.array(F.struct(F.lit(0).alias("part"), F.lit(0).alias("other"), F.lit(0).alias("side")))
        dealt = both.withColumn("to", F.explode(F.when(F.col("runs").isNull(), alone).otherwise(pairs))).select("mask", "pattern", "print", "to.*")
    keys = ["mask", "pattern", "part", "other"]
    width = max(partitions(spark), len(under) * n // 500_000)
    dealt = dealt.repartition(width, *keys).sortWithinPartitions(*keys)

    def run_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        last = None

        def out(rows: np.ndarray):
            """rows: mask, pattern, part, other, side, print as int64; whole nodes."""
            cut = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(axis=1)) + 1
            child, parent = [], []
            for some in np.split(rows, cut):
                prints, side = np.ascontiguousarray(some[:, 5]).view(np.uint64), some[:, 4]
                if len(prints) > 1:
                    a, b = linked(prints, most) if some[0, 2] == some[0, 3] else linked(prints[side == 0], most, prints[side == 1])
                    child.append(a)
                    parent.append(b)
            child, parent = (np.concatenate([*x, np.zeros(0, np.uint64)]).astype(np.uint64).view(np.int64) for x in (child, parent))
            keep = child != parent
            return pa.RecordBatch.from_arrays([pa.array(child[keep]), pa.array(parent[keep])], ["child", "parent"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (*keys, "side", "print")], axis=1)
            if last is not None:
                rows = np.concatenate([*held, rows])
                held = []
            same = (rows[:, :4] == rows[-1, :4]).all(axis=1)
            begin = int(np.argmax(same))  # rows are sorted, so the last node begins here
            if begin:
                yield out(rows[:begin])
            held, last = [rows[begin:]], True
        if held:
            yield out(np.concatenate(held))

    return dealt.select(*keys, "side", "print").mapInArrow(run_nodes, "child long, parent long").distinct()


def _least(prints: DataFrame, of: Column, most: int, node: int, part: int) -> tuple[DataFrame, int]:
    """print, least (the smallest `of` among the rows of its component) and rows (that have it) of every different fingerprint; the number of all rows."""
    first = materialize(prints.groupBy("print").agg(F.min(of).alias("first"), F.count("*").alias("rows")), "different-prints")
    count = first.agg(F.count("*").alias("n"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).first()
    group = components(links(first.select("print"), count.n, most, node, part), "child", "parent").withColumnRenamed("node", "print")
    linked_ = materialize(first.join(group, "print"), "linked-prints")
    least = materialize(linked_.groupBy("root").agg(F.min("first").alias("least"), F.count("*").alias("n")), "least-of-components")
    tied = spread_join(linked_, linked_.count(), least, "root", "n").select("print", "least", "rows")
    alone = first.join(linked_.select("print"), "print", "left_anti").select("print", F.col("first").alias("least"), "rows")
    return tied.unionByName(alone), count.rows


def near_duplicates(docs: DataFrame, *, words: int = WORDS, most: int = MOST, node: int = NODE, part: int = PART) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable) of every document.

    Documents whose fingerprints differ in at most `most` bits are linked, and links are followed to the end. Null and
    empty texts have fingerprint zero and are linked like any other. Repeated rows each give a row; a null doc_id is
    no component's smallest unless it has no other. An empty table gives an empty result; extra columns are left behind.
    """
    prints = materialize(fingerprints(docs, words), "prints")
    ids, count = _least(prints, F.col("doc_id"), most, node, part)
    out = spread_join(prints, count, materialize(ids.withColumnRenamed("least", "component_id"), "least"), "print", "rows")
    return out.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def kept_of_each(docs: DataFrame, *, words: int = WORDS, most: int = MOST, node: int = NODE, part: int = PART) -> DataFrame:
    """doc_id, mark (xxhash64 of the text) and stays of every row: whether it is its component's row of the smallest id, and
    of that id's the smallest mark. A null doc_id comes last. Rows that repeat id and text all stay or all go."""
    prints = materialize(fingerprints(docs, words, marks=True), "prints")
    ids, count = _least(prints, F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark"), most, node, part)
    same = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("mark") == F.col("least.mark"))
    return spread_join(prints, count, materialize(ids, "least"), "print", "rows").select("doc_id", "mark", same.alias("stays"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
