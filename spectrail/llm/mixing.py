"""Mixing sources to target weights.

Every source gets a target of words; its documents are repeated floor(rate) times, and one more copy goes to the
documents whose hash-seeded draw is below the fraction of the rate. Independent draws miss a small or heavy-tailed
source's target by many per cent (README), so the bound on the draw is moved from the fraction to the place where the
drawn documents' words reach the words still missing, and the gap that is left goes to one more document of a fitting
size: the draws stay hash-seeded and a document's chance stays the fraction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
SEED = "mix-1"
#: Draws have 60 bits; their leading bits deal a source's documents into this many buckets.
BUCKET_BITS = 12


def words(text: str = "text"):
    """Number of runs of anything but space and the controls 9 to 13; null: 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: str, size: str, seed: str = SEED):
    """A 60-bit hash of seed, doc_id and size: the first 15 hex digits of an MD5."""
    key = F.concat_ws("|", F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.col(size).cast("string"))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def mixture(docs: DataFrame, *, share: float = SHARE, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> tuple[DataFrame, DataFrame, int]:
    """(sized, plan, number of sources) for documents with doc_id, source and text.

    sized: doc_id, source, size, draw of every document. plan: a row for each source with source, source_size, target,
    whole (copies that all its documents get), bound (draws at or below it get one more; null: none) and more (the one
    draw above it that does as well; null: none).
    Sources by code point, null last, weigh `weights` in turn and share `share` of all words; a target stops at `cap`
    times its source's words, and the excess goes to the others by weight until none is above. A source without words
    has target 0. Rows that repeat a doc_id and size share one draw. Null texts have no words. An empty table has
    an empty plan.
    """
    sized = docs.select("doc_id", "source", words().alias("size")).withColumn("draw", draw("doc_id", "size", seed))
    sized = materialize(sized, "mix-sized")
    # A row for each source from here on, so one task may rank them.
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.array(*[F.lit(w) for w in weights])
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = sources.withColumn("weight", F.get(pick, ((F.row_number().over(by_name) - 1) % len(weights)).cast("int")))
    sources = sources.withColumn("ratio", F.lit(cap) * F.col("source_size") / F.col("weight").cast("double"))
    everything = Window.partitionBy(F.lit(0))
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    # The level if exactly the sources of smaller ratio are capped; the first source it does not lift above its cap, and all after it, are not.
    level = (F.lit(share) * F.sum("source_size").over(everything).cast("double") - F.coalesce(F.sum(F.lit(cap) * F.col("source_size")).over(before), F.lit(0)).cast("double")) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    ).cast("double")
    place = F.row_number().over(Window.orderBy("ratio", F.col("source").asc_nulls_last()))
    sources = sources.withColumn("level", level).withColumn("place", place)
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("place", "level"))).over(everything)
    sources = sources.withColumn("first", first).withColumn("open", F.coalesce(F.col("place") >= F.col("first")["place"], F.lit(False)))
    sources = sources.withColumn("target", F.when(F.col("open"), F.col("first")["level"] * F.col("weight")).otherwise((F.lit(cap) * F.col("source_size")).cast("double")))
    sources = sources.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    sources = sources.withColumn("missing", F.col("target") - F.col("whole") * F.col("source_size"))
    sources = materialize(sources.select("source", "source_size", "target", "whole", "missing"), "mix-sources")
    n = sources.count()
    # Words by source and bucket of the draw, summed on the map side: no source or group of copies meets in one task.
    bucket = F.shiftright(F.col("draw"), 60 - BUCKET_BITS).alias("bucket")
    coarse = sized.groupBy("source", bucket).agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    coarse = coarse.withColumn("base", F.coalesce(F.sum("words").over(upto), F.lit(0)))
    coarse = coarse.join(small(sources.select(F.col("source").alias("s"), "missing"), n), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    coarse = coarse.where((F.col("missing") > 0) & (F.col("base") <= F.col("missing")))
    # The last bucket that begins within the missing words holds the bound; only its documents are ranked one by one.
    last = coarse.groupBy("source").agg(F.max_by(F.struct("bucket", "base", "missing"), "bucket").alias("at")).select(F.col("source").alias("s"), "at.*")
    last = materialize(last, "mix-last")
    near = sized.select("source", bucket, "draw", "size").join(small(last, n), F.col("source").eqNullSafe(F.col("s")) & (sized["draw"].isNotNull()) & (F.shiftright(F.col("draw"), 60 - BUCKET_BITS) == last["bucket"]))
    near = near.groupBy("source", "draw", "base", "missing").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("source").orderBy("draw").rowsBetween(Window.unboundedPreceding, -1)
    near = near.withColumn("start", F.col("base") + F.coalesce(F.sum("words").over(upto), F.lit(0)))
    taken = near.where(F.col("start") + F.col("words") <= F.col("missing")).groupBy("source").agg(F.max(F.struct("draw", (F.col("start") + F.col("words")).alias("upto"))).alias("in"))
    bounds = last.join(taken.select(F.col("source").alias("t"), "in"), F.col("s").eqNullSafe(F.col("t")), "left")
    bounds = bounds.select(
        "s",
        F.coalesce(F.col("in")["draw"], F.shiftleft(F.col("bucket").cast("long"), 60 - BUCKET_BITS) - 1).alias("bound"),
        (F.col("missing") - F.coalesce(F.col("in")["upto"], F.col("base"))).alias("left"),
    )
    bounds = materialize(bounds, "mix-bounds")
    # One more document of each source may close the gap: the one of the fitting size, if that comes nearer.
    beyond = sized.join(small(bounds, n), F.col("source").eqNullSafe(F.col("s"))).where(F.col("draw") > F.col("bound"))
    nearest = beyond.groupBy(F.col("s")).agg(F.min(F.struct(F.abs(F.col("size") - F.col("left")).alias("off"), "draw", "left")).alias("m")).select("s", "m.draw", "m.left")
    nearest = materialize(nearest.withColumnsRenamed({"draw": "more", "left": "gap"}), "mix-nearest")
    whole = sized.join(small(nearest, n), F.col("source").eqNullSafe(F.col("s")) & (F.col("draw") == F.col("more"))).groupBy("s", "more", "gap").agg(F.sum("size").alias("words"))
    whole = whole.where(F.abs(F.col("words") - F.col("gap")) < F.col("gap")).select(F.col("s").alias("e"), "more")
    bounds = bounds.join(small(whole, n), F.col("s").eqNullSafe(F.col("e")), "left").select("s", "bound", "more")
    plan = sources.join(small(bounds, n), F.col("source").eqNullSafe(F.col("s")), "left").select("source", "source_size", "target", "whole", "bound", "more")
    return sized, materialize(plan, "mix-plan"), n


def with_copies(sized: DataFrame, plan: DataFrame, n: int) -> DataFrame:
    """`sized` rows with source_size, target and copies, the number of times the mix takes the document."""
    plan = plan.withColumnRenamed("source", "plan_source")
    out = sized.join(small(plan, n), F.col("source").eqNullSafe(F.col("plan_source")))
    extra = F.coalesce((F.col("draw") <= F.col("bound")) | F.col("draw").eqNullSafe(F.col("more")), F.lit(False)).cast("int")
    return out.withColumn("copies", F.col("whole") + extra).drop("plan_source", "whole", "bound", "more")


def mix(docs: DataFrame, **how) -> DataFrame:
    """The documents, each as often as the mix takes it, with their own columns."""
    _, plan, n = mixture(docs, **how)
    own = [F.col("d")[c].alias(c) for c in docs.columns]
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("d"), "source", "doc_id", words().alias("size"))
    rows = rows.withColumn("draw", draw("doc_id", "size", how.get("seed", SEED)))
    taken = with_copies(rows, plan, n).where(F.col("copies") > 0)
    return taken.select("d", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select(*own)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    out = with_copies(*mixture(docs))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
drawn AS (
  SELECT *, ('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, 'null') || '|' || size::VARCHAR), 1, 15))::BIGINT AS draw FROM sized),
named AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM drawn GROUP BY source),
weighed AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM named),
ranked AS (
  SELECT *, (2 * source_size)::DOUBLE / weight::DOUBLE AS ratio FROM weighed),
levels AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
      - coalesce(sum(2 * source_size) OVER before, 0)::DOUBLE)
      / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS lvl,
      row_number() OVER (ORDER BY ratio, source ASC NULLS LAST) AS place
  FROM ranked
  WINDOW before AS (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
settled AS (SELECT arg_min(lvl, place) AS settled, min(place) AS since FROM levels WHERE lvl <= ratio),
targets AS (
  SELECT source, source_size,
    CASE WHEN place >= since THEN settled * weight ELSE (2 * source_size)::DOUBLE END AS target
  FROM levels CROSS JOIN settled),
plans AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM targets),
units AS (
  SELECT source, draw, sum(size)::BIGINT AS w FROM drawn GROUP BY source, draw),
starts AS (
  SELECT *, coalesce(sum(w) OVER (PARTITION BY source ORDER BY draw ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM units),
missing AS (SELECT source AS s, target - whole * source_size AS missing FROM plans),
bounds AS (
  SELECT s, missing, max(CASE WHEN start + w <= missing THEN draw END) AS bound, missing - coalesce(max(CASE WHEN start + w <= missing THEN start + w END), 0) AS gap
  FROM starts u JOIN missing ON u.source IS NOT DISTINCT FROM s WHERE missing > 0 GROUP BY s, missing),
nearest AS (
  SELECT s, gap, arg_min(draw, (abs(size - gap), draw)) AS more FROM drawn JOIN bounds ON source IS NOT DISTINCT FROM s WHERE draw > coalesce(bound, -1) GROUP BY s, gap),
chosen AS (SELECT n.s AS e, more FROM nearest n JOIN units u ON u.source IS NOT DISTINCT FROM n.s AND u.draw = more WHERE abs(w - gap) < gap)
SELECT d.doc_id, d.size, p.source_size, p.target,
  (d.size * (p.whole + CASE WHEN d.draw <= b.bound OR d.draw = c.more THEN 1 ELSE 0 END))::BIGINT AS taken
FROM drawn d JOIN plans p ON d.source IS NOT DISTINCT FROM p.source LEFT JOIN bounds b ON p.source IS NOT DISTINCT FROM b.s
LEFT JOIN chosen c ON p.source IS NOT DISTINCT FROM c.e
"""
