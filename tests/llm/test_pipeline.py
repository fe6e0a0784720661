"""The pipeline's stages against brute force, each on what the one before it kept, and the driver contract."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from helpers import DOCS, odd_rows, some_docs
from spectrail.llm import decontaminate, mixing, toxicity
from test_operators import brute_components, brute_leaks, check_shards, simple_print, toxic_rows


@pytest.fixture(autouse=True)
def short_training(monkeypatch):
    monkeypatch.setattr(toxicity, "STEPS", 150)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables with toxic documents, near copies and benchmark passages."""
    top = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(7)
    docs = [(d, t, "en", s, n) for d, t, _, s, n in some_docs(150, seed=8)]
    toxic = toxic_rows(400, 9)
    docs += [(10_000 + i, t, "en", f"src{i % 4}", len(t)) for i, t, _ in toxic]
    items = [(i, " ".join(rng.choice("alpha beta gamma delta eps zeta".split()) for _ in range(20))) for i in range(6)]
    docs += [(20_000 + i, f"start of text {i} {items[i % 6][1]} and the end of it {i}", "en", "src1", 9) for i in range(20)]
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    labels = [(10_000 + i, 1, y) for i, _, y in toxic]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    return top


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("score", F.lit("kept"))
    columns, seen = docs.columns, [docs.collect()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        assert i == 4 or docs.columns == columns, name
        seen.append(docs.collect())
    given, clean, single, free, mixed, placed = seen
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    kept = {r.doc_id for r in clean}
    wrong = [d for d, y in labels.items() if (d in kept) == bool(y)]
    assert len(wrong) <= 0.05 * len(labels)
    root = brute_components([simple_print(r.text) for r in clean], 4)
    ids = [r.doc_id for r in clean]
    least = {}
    for i, r in enumerate(root):
        least[r] = min(least.get(r, ids[i]), ids[i])
    assert sorted(r.doc_id for r in single) == sorted(least.values())
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert sorted(r.doc_id for r in free) == sorted(r.doc_id for r in single if not brute_leaks(r.text, items)[1])
    assert len(free) < len(single)
    before = spark.read.parquet(str(tmp_path / "2"))
    copies = {r.doc_id: r.copies for r in mixing.with_copies(*mixing.mixture(before)).collect()}
    got = {}
    for r in mixed:
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
        assert tuple(r) == tuple(next(x for x in free if x.doc_id == r.doc_id))
    assert got == {d: n for d, n in copies.items() if n}
    check_shards(placed, len(mixed), 8)
    assert sorted(r.doc_id for r in placed) == sorted(r.doc_id for r in mixed)


def test_stages_on_odd_rows(spark, folder):
    odd = spark.createDataFrame(odd_rows(), DOCS)
    for df in (odd, odd.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, folder)
            n = out.count()
            assert n <= 3 * df.count() and (name != "toxicity" or n == df.count()), name
    kept = corpus_pipeline.drop_near_duplicates(spark, odd, folder).collect()
    assert len({(r.doc_id, r.text) for r in kept}) == len(kept) == len(kept_of_each_by_force(odd_rows()))


def kept_of_each_by_force(rows):
    """(id, text) of one row of each group: the smallest id, null last."""
    rows = sorted({(r[0], r[1]) for r in rows}, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or ""))
    root = brute_components([simple_print(t) for _, t in rows], 4)
    return [rows[r] for r in sorted(set(root))]


def test_columns_that_clash(spark, folder):
    """Columns named like those that the stages make inside, or like the digest's, in any case."""
    names = "size SHARD slot copies mark _mark text_mark doc_id_of mark_of score predicted _toxic _size _hub _class _row _spans _d _m print root least _range".split()
    docs = spark.createDataFrame(some_docs(40, seed=3), DOCS)
    docs = docs.withColumns({n: F.lit(n) for n in names})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        rows = out.collect()
        assert rows, name
        if name != "sharding":
            assert out.columns == docs.columns and all(r[n] == n for r in rows for n in names), name
    assert {"text", "copies", "_row", "_class"} < set(out.columns) and all(r["_row"] == "_row" and isinstance(r["size"], int) for r in rows)


def test_near_duplicates_are_told_apart_by_text(spark, folder):
    rng = random.Random(3)
    text = lambda: " ".join("".join(rng.choice("abcdefghijklm") for _ in range(6)) for _ in range(40))
    own, shared, other, third, fourth = [text() for _ in range(30)], text(), text(), text(), text()
    # Texts without an id, one of them twice; a text with and without an id; an id with a near-duplicate and another text; an id of two texts.
    rows = [(None, t) for t in [*own, own[0], shared]] + [(7, shared), (7, shared), (9, shared), (9, other), (11, own[1] + " x"), (11, own[2] + " y"), (12, third), (12, fourth), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS).repartition(3)
    got = corpus_pipeline.drop_near_duplicates(spark, docs, folder)
    assert got.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    want = kept_of_each_by_force(rows)
    blank = [r for r in want if not r[1]]
    assert [r for r in got if r[1]] == sorted((r for r in want if r[1]), key=str) and len(got) == len(want) and len(blank) == 1
    assert {(7, shared), (9, other), (12, third), (12, fourth)} <= set(got)


def test_run_and_contract(spark, folder):
    found, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert {f"op{i}_" for i in range(1, 11)} == {k.split("_")[0] + "_" for k in found if k.startswith("op")} and "pipeline" in found and set(sql) <= set(found)
    out = found["pipeline"](spark, folder)
    assert out.columns[:7] == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"] and "text" in out.columns and out.count() > 100


def test_decontamination_query_agrees_with_sql(spark, folder):
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    for query, sql in ((decontaminate.query, decontaminate.SQL), (mixing.query, mixing.SQL)):
        got = query(spark, folder)
        rows = sorted(map(tuple, got.collect()))
        names = ", ".join(got.columns)
        assert rows == sorted(con.execute(f"SELECT {names} FROM ({sql})").fetchall())


def test_classifier_is_deterministic(spark, folder):
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    texts, ys = toxicity.sample(docs, labels)
    again = toxicity.sample(docs.repartition(5), labels.repartition(2))
    assert (texts, ys) == again
