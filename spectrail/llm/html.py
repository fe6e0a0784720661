"""HTML extraction by tree scoring (see html_tree)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrail.ship import ship

from .html_tree import main_text
from .tokens import slices


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page. A null or empty page has an empty text. No shuffle.

    Repeated rows each give a row, an empty table none; other columns are left behind. A page is read whole in one task, in time
    proportional to its length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, pages in slices(batch, "html"):
                texts = [main_text(p) for p in pages]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    ship(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
