"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """(node, root) of every node of the edges, root being its component's smallest node.

    Alternates large and small stars: each node's larger neighbours, then its smaller ones, are tied to the smallest
    node seen, until nothing changes. Every round is two grouped minima and two joins by key, written to the shared
    folder; a hub's edges are dealt by Spark's skew join, and no node's neighbours are gathered. Loops are ignored; an
    empty table has no nodes.
    """
    pair = edges.select(F.greatest(child, parent).alias("c"), F.least(child, parent).alias("p")).where("c > p").distinct()
    pair = materialize(pair, "edges")
    state = _state(pair)
    while state[0]:
        both = pair.unionByName(pair.select(F.col("p").alias("c"), F.col("c").alias("p")))
        least = both.groupBy("c").agg(F.min("p").alias("m")).select(F.col("c").alias("x"), F.least("c", "m").alias("m"))
        large = both.where("p < c").select(F.col("c").alias("y"), F.col("p").alias("x")).join(least, "x")
        # y is a larger neighbour of x; the pair (x, its own least) is among these as well.
        large = large.select(F.col("y").alias("c"), F.col("m").alias("p")).where("c > p").distinct()
        large = materialize(large, "large-star")
        least = large.groupBy("c").agg(F.min("p").alias("m"))
        small = large.join(least, "c").where("p > m").select(F.col("p").alias("c"), F.col("m").alias("p"))
        pair = materialize(least.select("c", F.col("m").alias("p")).unionByName(small).distinct(), "small-star")
        now = _state(pair)
        if now == state:
            break
        state = now
    return pair.select(F.col("c").alias("node"), F.col("p").alias("root")).unionByName(pair.select(F.col("p").alias("node"), F.col("p").alias("root")).distinct())


def _state(pair: DataFrame) -> tuple[int, int]:
    row = pair.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("c", "p")), F.lit(0)).alias("x")).first()
    return row.n, row.x
