"""Watches a folder for index files of archives and registers each new archive once.

The engine's own operators are all batch; this is an addition. The stream's checkpoint remembers which files were seen,
and a run that is in the dataset already is skipped, so a repeated micro-batch changes nothing.
"""

from __future__ import annotations

import os
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from spectrail.operators.ingest import add_archives
from spectrail.sources import manifest as mf
from spectrail.sources.archive import INDEX, Archive


def watch(spark: SparkSession, folder: str, path: str, checkpoint: str):
    """A started query over folder/*/<index file>; archives go into the dataset at `path`."""
    files = spark.readStream.format("binaryFile").option("pathGlobFilter", INDEX).option("recursiveFileLookup", True).schema("path string, modificationTime timestamp, length long, content binary").load(folder)

    def add(batch, _) -> None:
        # One row an archive: names alone reach the driver, as manifests live there.
        found = sorted(os.path.dirname(unquote(urlparse(r.path).path)) for r in batch.select("path").collect())
        held = {r["run_id"].lower() for r in mf.read(path)["runs"]}
        new = [a for a in found if Archive(spark, a).run_id().lower() not in held]
        if new:
            add_archives(spark, path, new)

    return files.select(F.col("path")).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
