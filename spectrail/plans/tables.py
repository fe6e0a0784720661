"""The driver's star-schema tables seen as spectra: an order is a spectrum, its lines are its points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrail.functions.order import with_position
from spectrail.sources.dataset import Dataset

_numbered: dict[tuple[int, str], DataFrame] = {}


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders with spectrum_id_ (by priority, then key) and spectrum_index (from 0 in each priority)."""
    key = (id(spark), sf_dir)
    if key not in _numbered:
        df = spark.read.parquet(f"{sf_dir}/orders.parquet")
        rank = F.ascii("o_orderpriority").cast("long")  # priorities differ in their first character
        df = df.withColumn("_by", rank * F.lit(1 << 44) + F.col("o_orderkey"))
        runs = df.groupBy("o_orderpriority").count().orderBy("o_orderpriority").collect()
        starts, base = [], 0
        for r in runs:
            starts += [F.lit(r.o_orderpriority), F.lit(base).cast("long")]
            base += r["count"]
        df = with_position(df, "_by").drop("_by")
        df = df.withColumn("spectrum_id_", (F.col("position") + 1).cast("int"))
        _numbered[key] = df.withColumn("spectrum_index", F.col("position") - F.element_at(F.create_map(*starts), F.col("o_orderpriority"))).drop("position")
    return _numbered[key]


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On-disk columns of spectra."""
    later = F.col("o_orderstatus") != "F"
    price = F.col("o_totalprice") / F.lit(100.0)
    return orders(spark, sf_dir).select(
        "spectrum_id_", F.col("o_orderpriority").alias("run_id"), "spectrum_index", F.col("o_orderkey").cast("string").alias("id"),
        F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3).alias("ms_level"),
        ((F.col("o_orderkey") % 3600).cast("double") / F.lit(60.0)).alias("time"),
        F.when(F.col("o_orderkey") % 3 == 0, 1).when(F.col("o_orderkey") % 3 == 1, -1).alias("scan_polarity"),
        F.when(F.col("o_orderkey") % 2 == 0, "MS:1000127").otherwise("MS:1000128").alias("spectrum_representation"),
        F.when(later, price).alias("selected_ion_mz"), F.when(later, price).alias("isolation_window_target"),
        F.when(later, F.lit(0.5)).alias("isolation_window_lower_offset"), F.when(later, F.lit(1.5)).alias("isolation_window_upper_offset"),
        F.col("o_totalprice").alias("total_ion_current"), F.when(later, F.col("spectrum_index")).cast("int").alias("precursor_index"),
        F.col("o_orderpriority").alias("data_origin"), F.col("o_custkey").alias("customer"),
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """spectrum_id_, mz, intensity and the line's discount."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_extendedprice", "l_quantity", "l_discount")
    ids = orders(spark, sf_dir).select("o_orderkey", "spectrum_id_")
    return lines.join(ids, lines["l_orderkey"] == ids["o_orderkey"]).select("spectrum_id_", (F.col("l_extendedprice") / F.lit(100.0)).alias("mz"), F.col("l_quantity").alias("intensity"), F.col("l_discount").alias("sn"))


def with_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """metadata with each spectrum's points as lists in order of m/z; null where there are none."""
    rows = points(spark, sf_dir).groupBy("spectrum_id_").agg(F.array_sort(F.collect_list(F.struct("mz", "intensity", "sn"))).alias("p"))
    rows = rows.select("spectrum_id_", *[F.col(f"p.{c}").alias(c) for c in ("mz", "intensity", "sn")])
    return metadata(spark, sf_dir).join(rows, "spectrum_id_", "left")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each priority but the fifth."""
    p = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderpriority").alias("run_id")).distinct()
    number = F.substring("run_id", 1, 1).cast("int")
    return p.select("run_id", F.concat(F.lit("S"), number.cast("string")).alias("subject"), (number * 6).alias("timepoint"), (number / F.lit(2.0)).alias("ratio")).where(number < 5)


def native(spark: SparkSession, sf_dir: str) -> Dataset:
    return Dataset.of_frames(spark, with_lists(spark, sf_dir), samples=samples(spark, sf_dir))


def archive(spark: SparkSession, sf_dir: str) -> Dataset:
    return Dataset.of_frames(spark, metadata(spark, sf_dir), points(spark, sf_dir).drop("sn"), samples(spark, sf_dir))


SQL = """
WITH spectra AS (
  SELECT o_orderpriority AS run_id, o_orderkey AS k, o_custkey AS customer,
    (row_number() OVER (ORDER BY o_orderpriority, o_orderkey))::INTEGER AS spectrum_id_,
    row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS spectrum_index,
    CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS "msLevel",
    (o_orderkey % 3600)::DOUBLE / 60::DOUBLE * 60::DOUBLE AS rtime,
    CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS polarity,
    o_orderkey % 2 = 0 AS centroided,
    CASE WHEN o_orderstatus <> 'F' THEN o_totalprice / 100::DOUBLE END AS "precursorMz",
    o_totalprice AS tic, o_orderpriority AS "dataOrigin"
  FROM orders),
points AS (
  SELECT spectrum_id_, l_extendedprice / 100::DOUBLE AS mz, l_quantity AS intensity, l_discount AS sn FROM lineitem JOIN spectra ON l_orderkey = k),
peaks AS (
  SELECT *, (row_number() OVER (PARTITION BY spectrum_id_ ORDER BY mz, intensity, sn) - 1)::INTEGER AS peak_ FROM points),
samples AS (
  SELECT DISTINCT o_orderpriority AS run_id, 'S' || o_orderpriority[1] AS subject, o_orderpriority[1]::INTEGER * 6 AS timepoint, o_orderpriority[1]::INTEGER / 2::DOUBLE AS ratio
  FROM orders WHERE o_orderpriority[1]::INTEGER < 5)
"""
