"""The registered queries of the peak engine, and the DuckDB SQL that each must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrail.functions import peaks as pk
from spectrail.functions.vocab import BY_NAME
from spectrail.operators.handle import Handle
from spectrail.operators.ingest import first_and_count
from spectrail.operators.writer import cut_runs
from spectrail.sources.dataset import union_by_name
from spectrail.sources.runs import run_column

from . import tables
from .tables import SQL

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None):
    def register(f):
        QUERIES[f.__name__.strip("_")] = f
        if sql is not None:
            ORACLE_SQL[f.__name__.strip("_")] = SQL + sql
        return f

    return register


def _lists(spark: SparkSession, sf_dir: str) -> Handle:
    return tables.native(spark, sf_dir).spectra()


def _points(spark: SparkSession, sf_dir: str) -> Handle:
    return tables.archive(spark, sf_dir).spectra()


ID = "SELECT spectrum_id_ FROM spectra"


@_query('SELECT spectrum_id_, run_id, "msLevel", rtime, polarity, centroided, "precursorMz", "dataOrigin", customer FROM spectra')
def scan_translate(spark, sf_dir) -> DataFrame:
    return _lists(spark, sf_dir).spectra_data("spectrum_id_", "run_id", "msLevel", "rtime", "polarity", "centroided", "precursorMz", "dataOrigin", "customer")


@_query(f'{ID} WHERE "msLevel" IN (1, 3)')
def filter_ms_level(spark, sf_dir):
    return _lists(spark, sf_dir).filter_ms_level(1, 3).ids()


@_query(f"{ID} WHERE rtime BETWEEN 200 AND 300")
def filter_rt(spark, sf_dir):
    return _lists(spark, sf_dir).filter_rt(200, 300).ids()


@_query(f'{ID} WHERE (rtime BETWEEN 200 AND 300 AND "msLevel" = 1) OR "msLevel" <> 1')
def filter_rt_mslevel(spark, sf_dir):
    return _lists(spark, sf_dir).filter_rt(200, 300, ms_level=1).ids()


@_query(f"{ID} WHERE rtime >= 3000")
def filter_rt_open_bound(spark, sf_dir):
    return _lists(spark, sf_dir).filter_rt(3000, float("inf")).ids()


@_query(f"{ID} WHERE \"dataOrigin\" = '2-HIGH'")
def filter_data_origin(spark, sf_dir):
    return _lists(spark, sf_dir).filter_data_origin("2-HIGH").ids()


@_query("""SELECT spectrum_id_, row_number() OVER (ORDER BY CASE run_id WHEN '3-MEDIUM' THEN 0 ELSE 1 END, spectrum_id_) - 1 AS place
FROM spectra WHERE "dataOrigin" IN ('3-MEDIUM', '1-URGENT')""")
def filter_data_origin_reorder(spark, sf_dir):
    h = _lists(spark, sf_dir).filter_data_origin("3-MEDIUM", "1-URGENT")
    return h.placed().select("spectrum_id_", "place").orderBy("place")


@_query(f'{ID} WHERE "precursorMz" BETWEEN 500 AND 900')
def filter_precursor_range(spark, sf_dir):
    return _lists(spark, sf_dir).filter_precursor_mz_range(500, 900).ids()


@_query(f'{ID} WHERE "precursorMz" BETWEEN 995 AND 1005 OR "precursorMz" BETWEEN 1995 AND 2005')
def filter_precursor_values(spark, sf_dir):
    return _lists(spark, sf_dir).filter_precursor_mz_values([1000, 2000], ppm=0, tolerance=5).ids()


@_query("SELECT DISTINCT spectrum_id_ FROM points WHERE mz BETWEEN 99 AND 101 OR mz BETWEEN 299 AND 301")
def filter_contains_mz(spark, sf_dir):
    return _points(spark, sf_dir).filter_contains_mz([100, 300], tolerance=1, ppm=0).ids()


@_query("SELECT DISTINCT spectrum_id_ FROM points WHERE mz BETWEEN 99 AND 101 OR mz BETWEEN 299 AND 301")
def filter_contains_mz_lists(spark, sf_dir):
    return _lists(spark, sf_dir).filter_contains_mz([100, 300], tolerance=1, ppm=0, allow_native=True).ids()


@_query(f"{ID} JOIN samples USING (run_id) WHERE timepoint > 6 AND subject <> 'S4'")
def filter_sample_data(spark, sf_dir):
    return _lists(spark, sf_dir).filter_sample_data("timepoint > 6 AND subject <> 'S4'").ids()


@_query('SELECT spectrum_id_, rtime FROM spectra WHERE spectrum_id_ BETWEEN 11 AND 60')
def subset_contiguous(spark, sf_dir):
    return _lists(spark, sf_dir).take(range(10, 60)).spectra_data("spectrum_id_", "rtime")


@_query('SELECT spectrum_id_, rtime FROM spectra WHERE spectrum_id_ IN (2, 4, 9, 100, 101)')
def subset_listed(spark, sf_dir):
    return _lists(spark, sf_dir).take([1, 3, 8, 99, 100]).spectra_data("spectrum_id_", "rtime")


@_query("SELECT spectrum_id_, rtime, (SELECT count(*) FROM spectra) - spectrum_id_ AS place FROM spectra")
def subset_joined(spark, sf_dir):
    """All spectra by their places, backwards."""
    h = _lists(spark, sf_dir)
    return h.take(range(h.count() - 1, -1, -1)).frame.select("spectrum_id_", "rtime", F.col("ord_").alias("place")).orderBy("place")


@_query("SELECT spectrum_id_, rtime, place FROM spectra JOIN (VALUES (6, 0), (3, 1), (6, 2), (1, 3)) v(i, place) ON i = spectrum_id_")
def subset_duplicates(spark, sf_dir):
    h = _lists(spark, sf_dir).take([5, 2, 5, 0])
    return h.frame.select("spectrum_id_", "rtime", F.col("ord_").cast("int").alias("place")).orderBy("place")


@_query("""SELECT spectrum_id_, row_number() OVER (ORDER BY p, spectrum_id_) - 1 AS place FROM (
  SELECT 1 AS p, spectrum_id_ FROM spectra WHERE "msLevel" = 3 UNION ALL SELECT 2, spectrum_id_ FROM spectra WHERE rtime BETWEEN 100 AND 200)""")
def merge_handles(spark, sf_dir):
    h = _lists(spark, sf_dir)
    return h.filter_ms_level(3).merge(h.filter_rt(100, 200)).placed().select("spectrum_id_", "place").orderBy("place")


@_query('SELECT rtime, spectrum_id_, "precursorMz" FROM spectra WHERE "msLevel" = 2')
def spectra_data_columns(spark, sf_dir):
    return _lists(spark, sf_dir).filter_ms_level(2).spectra_data("precursorMz", "rtime", "spectrum_id_")


@_query("SELECT spectrum_id_, peak_, mz, intensity FROM peaks")
def peaks_data_lists(spark, sf_dir):
    return _lists(spark, sf_dir).peaks_data(long=True)


@_query("SELECT spectrum_id_, peak_, mz, intensity FROM peaks")
def peaks_data_points(spark, sf_dir):
    return _points(spark, sf_dir).peaks_data(long=True)


@_query("SELECT spectrum_id_, peak_, intensity FROM peaks JOIN spectra USING (spectrum_id_) WHERE rtime <= 600")
def peaks_single_column(spark, sf_dir):
    return _points(spark, sf_dir).filter_rt(float("-inf"), 600).peaks_data("intensity", long=True)


@_query("SELECT spectrum_id_, peak_, sn, mz FROM peaks")
def peaks_annotations(spark, sf_dir):
    return _lists(spark, sf_dir).peaks_data("sn", "mz", long=True)


@_query("SELECT spectrum_id_, peak_, mz, CASE WHEN peak_ < 2 THEN intensity END AS intensity FROM peaks")
def peaks_padding(spark, sf_dir):
    """A list that is shorter than the other is filled with nulls."""
    df = tables.with_lists(spark, sf_dir).withColumn("intensity", F.slice("intensity", 1, 2))
    return df.select("spectrum_id_", F.posexplode(pk.packed("mz", "intensity")).alias("peak_", "p")).select("spectrum_id_", "peak_", "p.mz", "p.intensity")


@_query("SELECT spectrum_id_, tic FROM spectra")
def tic_initial(spark, sf_dir):
    return _lists(spark, sf_dir).tic()


@_query("SELECT spectrum_id_, coalesce(sum(intensity), 0) AS tic FROM spectra LEFT JOIN points USING (spectrum_id_) GROUP BY spectrum_id_")
def tic_computed(spark, sf_dir):
    return _lists(spark, sf_dir).tic(initial=False)


@_query('SELECT spectrum_id_, coalesce(sum(intensity), 0) AS "ionCount" FROM spectra LEFT JOIN points USING (spectrum_id_) GROUP BY spectrum_id_')
def ion_count(spark, sf_dir):
    return _points(spark, sf_dir).ion_count()


@_query("SELECT spectrum_id_, count(mz)::INTEGER AS n_peaks FROM spectra LEFT JOIN points USING (spectrum_id_) GROUP BY spectrum_id_")
def peak_counts(spark, sf_dir):
    return _lists(spark, sf_dir).lengths()


@_query('SELECT DISTINCT "msLevel" FROM spectra')
def unique_ms_levels(spark, sf_dir):
    return spark.createDataFrame([(x,) for x in _lists(spark, sf_dir).unique_ms_levels()], "msLevel int")


@_query("SELECT count(*) AS n FROM spectra")
def n_spectra(spark, sf_dir):
    return _lists(spark, sf_dir).frame.agg(F.count("*").alias("n"))


@_query("SELECT run_id, count(*) AS n, min(spectrum_id_) AS first, max(spectrum_id_) AS last FROM spectra GROUP BY run_id")
def run_blocks(spark, sf_dir):
    return tables.metadata(spark, sf_dir).groupBy("run_id").agg(F.count("*").alias("n"), F.min("spectrum_id_").alias("first"), F.max("spectrum_id_").alias("last"))


@_query("""SELECT event_id, run_id FROM events LEFT JOIN (SELECT run_id, min(spectrum_id_) AS a, max(spectrum_id_) AS b FROM spectra GROUP BY run_id)
ON event_id * 2 BETWEEN a AND b""")
def run_of_ids(spark, sf_dir):
    """The run whose block of ids holds each id."""
    blocks = [(r.run_id, r["first"], r.n) for r in run_blocks(spark, sf_dir).collect()]
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", run_column(blocks, F.col("event_id") * 2).alias("run_id"))


@_query("""SELECT spectrum_id_, coalesce(hit, false) AS contains FROM spectra
LEFT JOIN (SELECT DISTINCT spectrum_id_, true AS hit FROM points WHERE mz BETWEEN 99 AND 101) USING (spectrum_id_)""")
def contains_mz_flag(spark, sf_dir):
    return _points(spark, sf_dir).contains_mz(100, tolerance=1, ppm=0)


@_query("SELECT run_id, count(*) AS n FROM spectra GROUP BY run_id")
def run_cutting(spark, sf_dir):
    """Runs from stretches of equal origin."""
    found = cut_runs(tables.metadata(spark, sf_dir).select(F.col("data_origin").alias("dataOrigin"), (F.col("spectrum_id_") - 1).alias("position")))
    return spark.createDataFrame([(o, n) for _, o, n in found], "run_id string, n long")


@_query("""SELECT l_orderkey AS source_index, count(*)::INTEGER AS n_scans, arg_min(l_extendedprice, (l_linenumber, l_extendedprice, l_partkey)) AS price,
  arg_min(l_quantity, (l_linenumber, l_extendedprice, l_partkey)) AS quantity FROM lineitem GROUP BY l_orderkey""")
def facet_first_row(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    lines = lines.withColumn("scan", F.struct("l_linenumber", "l_extendedprice", "l_partkey"))
    columns = [F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity")]
    return first_and_count(lines, "l_orderkey", "scan", columns, "n_scans").withColumnRenamed("_key", "source_index")


@_query("""SELECT spectrum_id_, spectrum_index, n AS n_scans, m AS first_line FROM spectra
LEFT JOIN (SELECT l_orderkey, count(*)::INTEGER AS n, min(l_linenumber) AS m FROM lineitem GROUP BY l_orderkey) ON l_orderkey = k""")
def flat_index(spark, sf_dir):
    """Spectra with the count and first row of their facet, as an archive's index is built."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    first = first_and_count(lines, "l_orderkey", "l_linenumber", [F.col("l_linenumber").alias("first_line")], "n_scans")
    o = tables.orders(spark, sf_dir).select("spectrum_id_", "spectrum_index", "o_orderkey")
    return o.join(first, o["o_orderkey"] == first["_key"], "left").select("spectrum_id_", "spectrum_index", "n_scans", "first_line")


@_query("""SELECT k::BIGINT AS k, a, b FROM (SELECT n_nationkey AS k, n_name AS a, NULL AS b FROM nation UNION ALL SELECT r_regionkey, NULL, r_name FROM region)""")
def union_by_name_(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("int").alias("k"), F.col("n_name").alias("a"))
    r = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_regionkey").cast("long").alias("k"), F.col("r_name").alias("b"))
    return union_by_name([n, r])


@_query("SELECT spectrum_id_, rtime + 1000 AS rtime FROM spectra WHERE rtime + 1000 BETWEEN 1200 AND 1300")
def overlay_shadow(spark, sf_dir):
    """A filter on a replaced variable uses its new values."""
    return _lists(spark, sf_dir).with_column("rtime", F.col("rtime") + 1000).filter_rt(1200, 1300).spectra_data("spectrum_id_", "rtime")


@_query("SELECT spectrum_id_, subject, timepoint, ratio FROM spectra LEFT JOIN samples USING (run_id)")
def sample_expand(spark, sf_dir):
    return _lists(spark, sf_dir).spectra_data("spectrum_id_", "subject", "timepoint", "ratio")


@_query('SELECT spectrum_id_, "precursorMz" - 0.5::DOUBLE AS low, "precursorMz" + 1.5::DOUBLE AS high FROM spectra')
def isolation_window(spark, sf_dir):
    df = _lists(spark, sf_dir).spectra_data("spectrum_id_", "isolationWindowLowerMz", "isolationWindowUpperMz")
    return df.withColumnsRenamed({"isolationWindowLowerMz": "low", "isolationWindowUpperMz": "high"})


@_query("SELECT polarity, centroided, count(*) AS n FROM spectra GROUP BY polarity, centroided")
def polarity_centroid_decode(spark, sf_dir):
    return _lists(spark, sf_dir).frame.groupBy("polarity", "centroided").agg(F.count("*").alias("n"))


@_query("""SELECT c AS variable, n FROM (SELECT count("precursorMz") AS "precursorMz", count(polarity) AS polarity, 0::BIGINT AS "injectionTime" FROM spectra) UNPIVOT (n FOR c IN ("precursorMz", polarity, "injectionTime"))""")
def all_null_columns(spark, sf_dir):
    """How often variables are known, in one pass; those never known are not written."""
    names = ["precursorMz", "polarity", "injectionTime"]
    assert all(n in BY_NAME for n in names)
    df = _lists(spark, sf_dir).frame.agg(*[F.count(n).alias(n) for n in names])
    return df.unpivot([], names, "variable", "n")


@_query("""SELECT c.spectrum_id_, p.spectrum_id_ AS parent FROM spectra c JOIN spectra p ON p.run_id = c.run_id AND p.spectrum_index = c.spectrum_index WHERE c."msLevel" > 1""")
def msn_parent_link(spark, sf_dir):
    """Each fragment spectrum with the spectrum that its precursor scan number names, in the same run."""
    f = _lists(spark, sf_dir).frame
    child = f.where("precScanNum IS NOT NULL").select("spectrum_id_", "run_id", F.col("precScanNum").cast("long").alias("spectrum_index"))
    parent = f.select(F.col("spectrum_id_").alias("parent"), "run_id", "spectrum_index")
    return child.join(parent, ["run_id", "spectrum_index"]).select("spectrum_id_", "parent")


@_query('SELECT spectrum_id_, "msLevel", rtime, "precursorMz" FROM spectra WHERE rtime BETWEEN 200 AND 300')
def suite_rt_range(spark, sf_dir):
    return _lists(spark, sf_dir).filter_rt(200, 300).spectra_data("spectrum_id_", "msLevel", "rtime", "precursorMz")


@_query('SELECT spectrum_id_, "msLevel", rtime, "precursorMz" FROM spectra WHERE rtime BETWEEN 250 AND 260')
def suite_rt_narrow(spark, sf_dir):
    return _lists(spark, sf_dir).filter_rt(250, 260).spectra_data("spectrum_id_", "msLevel", "rtime", "precursorMz")


@_query('SELECT spectrum_id_, "precursorMz" FROM spectra WHERE "precursorMz" BETWEEN 999.97::DOUBLE - 10 AND 999.97::DOUBLE + 10')
def suite_precursor(spark, sf_dir):
    return _lists(spark, sf_dir).filter_precursor_mz_values([999.97], ppm=0, tolerance=10).spectra_data("spectrum_id_", "precursorMz")


@_query('SELECT spectrum_id_, "precursorMz" FROM spectra WHERE rtime BETWEEN 200 AND 1300 AND "precursorMz" BETWEEN 950 AND 1050')
def suite_rt_and_precursor(spark, sf_dir):
    return _lists(spark, sf_dir).filter_rt(200, 1300).filter_precursor_mz_values([1000], ppm=0, tolerance=50).spectra_data("spectrum_id_", "precursorMz")


@_query('SELECT spectrum_id_, peak_, mz, intensity FROM peaks JOIN spectra USING (spectrum_id_) WHERE "msLevel" = 1 AND rtime BETWEEN 200 AND 1300')
def suite_ms1_peaks(spark, sf_dir):
    return _lists(spark, sf_dir).filter_ms_level(1).filter_rt(200, 1300).peaks_data(long=True)


@_query('SELECT spectrum_id_, coalesce(sum(intensity), 0) AS tic FROM spectra LEFT JOIN points USING (spectrum_id_) WHERE "msLevel" = 1 AND rtime BETWEEN 200 AND 1300 GROUP BY spectrum_id_')
def suite_ms1_tic(spark, sf_dir):
    return _lists(spark, sf_dir).filter_ms_level(1).filter_rt(200, 1300).tic(initial=False)


@_query('SELECT spectrum_id_, run_id, spectrum_index, "msLevel", rtime, polarity, "precursorMz" FROM spectra WHERE rtime BETWEEN 200 AND 300')
def suite_scan_info(spark, sf_dir):
    return _lists(spark, sf_dir).filter_rt(200, 300).spectra_data("spectrum_id_", "run_id", "spectrum_index", "msLevel", "rtime", "polarity", "precursorMz")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-level spectra of a time range or any with a matching precursor, with their peaks."""
    h = _lists(spark, sf_dir).filter_rt(0, 1800, ms_level=1).filter_precursor_mz_range(0, float("inf"))
    return h.peaks_data(long=True)


from . import on_files  # noqa: E402, F401  registers the queries over files
