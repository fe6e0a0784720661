"""Headline queries on a native dataset made from the tables in $BENCH_SF_DIR: prints one JSON line.

The dataset is written once, from a Parquet file of its spectra (its time is `ingest`); each query then runs on the files, the best of three runs counting.
"""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from spectrail import api  # noqa: E402
from spectrail.operators import cache  # noqa: E402
from spectrail.plans import tables  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = 3


def done(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    top = tempfile.mkdtemp(prefix="bench-")
    try:
        tables.with_lists(spark, SF_DIR).write.parquet(f"{top}/source")  # made from the tables before anything is timed
        began = time.time()
        raw = spark.read.parquet(f"{top}/source")
        frame = api.Dataset.of_frames(spark, raw).view().drop("_time", "run_id", "spectrum_index").withColumn("place", F.col("spectrum_id_"))
        data = api.create(spark, f"{top}/ds", frame, order_by="place", row_group=5000)
        seconds = {"ingest": time.time() - began}
        h, k = data.spectra(), data.spectra(cached=True)
        cache.whole(data).count()
        queries = {
            "rt_range": lambda: h.filter_rt(200, 300).spectra_data("spectrum_id_", "msLevel", "rtime", "precursorMz"),
            "rt_narrow": lambda: h.filter_rt(250, 260).spectra_data("spectrum_id_", "msLevel", "rtime", "precursorMz"),
            "precursor_ppm": lambda: h.filter_precursor_mz_values([1000.0], ppm=30).spectra_data("spectrum_id_", "precursorMz"),
            "rt_and_precursor": lambda: h.filter_rt(200, 1300).filter_precursor_mz_values([1000.0], ppm=30).spectra_data("spectrum_id_", "precursorMz"),
            "ms1_peaks": lambda: h.filter_ms_level(1).filter_rt(200, 1300).peaks_data(),
            "ms1_tic": lambda: h.filter_ms_level(1).filter_rt(200, 1300).tic(initial=False),
            "scaninfo": lambda: h.filter_rt(200, 300).spectra_data("spectrum_id_", "run_id", "msLevel", "rtime", "polarity", "centroided", "precursorMz"),
            "filter_ms_level": lambda: h.filter_ms_level(2).ids(),
            "contains_mz": lambda: h.filter_contains_mz([100.0, 300.0], tolerance=1, allow_native=True).ids(),
            "all_metadata": lambda: h.spectra_data("spectrum_id_", "msLevel", "rtime", "precursorMz", "totIonCurrent", "dataOrigin"),
            "ion_count": lambda: h.ion_count(),
            "unique_ms_levels": lambda: spark.createDataFrame([(x,) for x in h.unique_ms_levels()], "l int"),
            "cached_rt_range": lambda: k.filter_rt(200, 300).spectra_data("spectrum_id_", "msLevel", "rtime", "precursorMz"),
            "cached_rt_and_precursor": lambda: k.filter_rt(200, 1300).filter_precursor_mz_values([1000.0], ppm=30).spectra_data("spectrum_id_", "precursorMz"),
            "cached_ms1_peaks": lambda: k.filter_ms_level(1).filter_rt(200, 1300).peaks_data(),
        }
        for name, make in queries.items():
            best = []
            for _ in range(RUNS):
                t = time.time()
                done(make())
                best.append(time.time() - t)
            seconds[name] = min(best)
        seconds = {k: round(v, 4) for k, v in seconds.items()}
        total = round(sum(v for k, v in seconds.items() if k != "ingest"), 4)
        print(json.dumps({"metric": "peak_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(os.path.normpath(SF_DIR))}))
    finally:
        spark.stop()
        shutil.rmtree(top, ignore_errors=True)


if __name__ == "__main__":
    main()
