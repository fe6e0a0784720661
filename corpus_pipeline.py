"""The corpus pipeline: toxic documents go, of near-duplicates one stays, documents with benchmark passages go, sources are
mixed to their targets, and what is left is dealt to balanced shards.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read as the next one's docs. All
but the last return the columns of the documents they got; the last returns doc_id, size, text_crc32, law, shard, slot and
grown_shard of every row, and the documents' other columns. Null and empty texts are clean, have fingerprint zero, hold no
benchmark words and no words to mix. Extra columns pass through, those named like one of the digest's apart. Documents are told
apart by doc_id and text, those without a doc_id by their texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrail.llm import decontaminate, mixing, sharding, simhash, toxicity
from spectrail.llm.common import fresh, materialize, new_dir, small


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the classifier, fitted on the labels of those it may learn from, does not reject."""
    network = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score, predicted = fresh(docs.columns, "score", "predicted")
    return toxicity.classify(docs, network, score=score, predicted=predicted).where(F.col(predicted) == 0).select(*docs.columns)


def _marked(rows: DataFrame, condition: str, docs: DataFrame) -> tuple[DataFrame, Column]:
    """The documents of `rows` that meet a condition, and how rows of `docs` are matched with them: by doc_id and text hash."""
    key, mark = fresh(docs.columns, "doc_id_of", "mark_of")
    found = materialize(rows.where(condition).select(F.col("doc_id").alias(key), F.col("mark").alias(mark)).distinct(), "marked")
    return small(found, found.count()), docs["doc_id"].cast("long").eqNullSafe(F.col(key)) & (F.xxhash64(docs["text"]) == F.col(mark))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, that of the smallest id (null last) and then text hash.

    Rows are told apart by id and text, so those in no group all stay, also those without an id and those that share one. Of
    rows that repeat both, one stays.
    """
    rows = materialize(simhash.kept_of_each(docs).groupBy("doc_id", "mark", "stays").agg(F.count("*").alias("n")), "near-duplicates")
    gone, same = _marked(rows, "not stays", docs)
    kept = docs.join(gone, same, "left_anti")
    again, same = _marked(rows, "stays and n > 1", docs)
    (mark,) = fresh(docs.columns, "text_mark")
    repeated = kept.join(again, same, "left_semi").withColumn(mark, F.xxhash64("text")).dropDuplicates(["doc_id", mark])
    return kept.join(again, same, "left_anti").unionByName(repeated.drop(mark))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents without a benchmark passage."""
    gone, same = _marked(decontaminate.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), "n_hit > 0", docs)
    return docs.join(gone, same, "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for."""
    return mixing.mix(docs)


def to_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, its text included, with its shard and its slot in it; copies of a document go to one shard where there is room."""
    placed = sharding.shard(docs, with_text=True)
    return sharding.digest(placed, *[c for c in docs.columns if c.lower() not in {x.lower() for x in sharding.DIGEST}])


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", to_shards),
]

#: The first stage is a trained network, which SQL can't express; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of `sf_dir`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_dir(spark, f"stage-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
