"""Toxicity: scores of a bidirectional gated recurrent network, trained here on labelled documents.

A document is as toxic as its most toxic window. In training, a toxic document gives the window that counts most (by
word statistics at first, by the network's own scores later) and a clean one the window most like a toxic one and
another; at the end the scores are put on the scale of probabilities.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from spectrail.ship import ship

from .bigru import GRAMS, WINDOW, Adam, Network, Scorer, grams, starts, words
from .common import materialize, small
from .tokens import slices

#: The classifier is fitted on at most so many toxic and so many clean documents, chosen by a hash of doc_id.
TOXIC_SAMPLE, CLEAN_SAMPLE = 800, 2400
#: Their texts have at most so many bytes, all together, of either kind; a document that would pass this is not sampled.
SAMPLE_BYTES = 8_000_000
#: Training takes `STEPS` batches, dealt over at least EPOCHS epochs.
STEPS, EPOCHS, BATCH, RATE = 600, 8, 64, 0.01
#: Windows that a toxic document gives at most, if they count at least half as much as its best one.
TOP = 4
THRESHOLD = 0.7
#: Bytes of text that are scored at a time.
SLICE = 1_000_000


def held_out(doc_id: str = "doc_id"):
    """Whether labels of a document are never learnt from: crc32 of its id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


class _Windows(Sequence):
    """All windows of a text, each cut when it is asked for."""

    def __init__(self, words: list[bytes]) -> None:
        self.words, self.starts = words, starts(len(words)) if words else np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.starts)

    def __getitem__(self, i: int) -> list[bytes]:
        at = int(self.starts[i])
        return self.words[at : at + WINDOW]


def _windows(text: str, known: dict[bytes, bytes] | None = None) -> Sequence[list[bytes]]:
    """The windows; texts of one `known` share their words."""
    share = ({} if known is None else known).setdefault
    return _Windows([share(w, w) for w in words(text)])


def _tell(docs: list[Sequence[list[bytes]]], labels: np.ndarray) -> np.ndarray:
    """A first score of every window: how telling of toxic documents its most telling n-gram is."""
    seen = np.zeros((2, GRAMS))
    for windows, label in zip(docs, labels, strict=True):
        seen[int(label), np.unique(grams(sorted({x for w in windows for x in w}))[0])] += 1
    n = np.maximum(1, np.bincount(labels.astype(int), minlength=2))
    odds = np.log((seen[1] + 0.1) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
    weight = np.maximum(odds, 0) * np.sqrt(seen[1])
    return np.array([weight[g].max() if len(g := grams(w)[0]) else 0.0 for windows in docs for w in windows])


def _choose(score: np.ndarray, least: float, first: np.ndarray, label: np.ndarray, rng: np.random.Generator) -> list[tuple[int, int]]:
    """(document, window) of an epoch: the best windows of toxic documents, the two most like toxic and a random one of clean ones."""
    out = []
    for i, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
        own = score[a:b]
        if label[i]:
            top = np.argsort(-own, kind="stable")[:TOP]
            out += [(i, int(j)) for j in top if j == top[0] or own[j] >= least * own[top[0]]]
        else:
            out += [(i, int(j)) for j in np.argsort(-own, kind="stable")[:2]] + [(i, int(rng.integers(b - a)))]
    return out


def train(texts: list[str], labels: list[int], *, steps: int | None = None, rate: float = RATE, seed: int = 7) -> Network | None:
    """A network fitted to the texts; None unless both labels occur among those with words."""
    known: dict[bytes, bytes] = {}
    kept = [(w, y) for t, y in zip(texts, labels, strict=True) if (w := _windows(t, known))]
    if len({y for _, y in kept}) < 2:
        return None
    docs, label = [d for d, _ in kept], np.array([y for _, y in kept], np.float32)
    counts = Counter(x for d in docs for x in {x for w in d for x in w})
    vocabulary = {x: i + 1 for i, (x, n) in enumerate(sorted(counts.items())) if n > 1}
    vocabulary = {x: i + 1 for i, x in enumerate(vocabulary)}
    net, rng = Network(vocabulary, seed), np.random.default_rng(seed)
    adam = Adam(net.p, rate)
    first = np.cumsum([0, *[len(d) for d in docs]])
    score, epoch, done = _tell(docs, label), 0, 0
    steps = max(steps or STEPS, EPOCHS)
    while done < steps:
        if epoch:
            score = 1 / (1 + np.exp(-_logits(net, docs)))
        todo = _choose(score, 0.5, first, label, rng)
        # Toxic windows repeat until they are a seventh; an epoch has its share of the steps.
        toxic = [x for x in todo if label[x[0]]]
        todo += toxic * max(0, int((len(todo) - len(toxic)) / 6 / len(toxic)) - 1)
        todo *= max(1, steps * BATCH // (len(todo) * EPOCHS))
        rng.shuffle(todo)
        todo = todo[: max(BATCH, steps * BATCH // EPOCHS)]
        epoch += 1
        order = rng.permutation(len(todo))
        for at in range(0, len(order), BATCH):
            some = [todo[i] for i in order[at : at + BATCH]]
            adam.rate = rate if done < 0.7 * steps else rate / 4
            done += 1
            picked = [docs[i][j] for i, j in some]
            found = sorted({x for w in picked for x in w})
            place = {x: i for i, x in enumerate(found)}
            ids, mask = np.zeros((WINDOW, len(some)), np.int64), np.zeros((WINDOW, len(some)), bool)
            for n, w in enumerate(picked):
                ids[: len(w), n], mask[: len(w), n] = [place[x] for x in w], True
            adam.apply(net.p, net.gradients(found, ids, mask, label[[i for i, _ in some]], rng)[1])
    logit = _logits(net, docs)
    best = np.array([logit[a:b].max() for a, b in zip(first[:-1], first[1:], strict=True)])
    net.scale, net.shift = _calibrate(best, label)
    return net


def _logits(net: Network, docs: list[Sequence[list[bytes]]]) -> np.ndarray:
    """The logit of every window of the documents; a bounded number of windows is text at a time."""
    scorer, out = Scorer(net), []
    flat = (b" ".join(w).decode() for d in docs for w in d)
    while some := list(islice(flat, 4096)):
        out.append(scorer.windows(some)[2])
    return np.concatenate(out)


def _calibrate(best: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Scale and shift of a logistic fit, held back by a penalty on the scale."""
    mid = (best[label == 1].mean() + best[label == 0].mean()) / 2
    x, a, b = best - mid, 1.0, 0.0
    for _ in range(400):
        g = (1 / (1 + np.exp(-np.clip(a * x + b, -50, 50))) - label) / len(label)
        a, b = max(0.05, a - 0.5 * ((g * x).sum() + 0.01 * (a - 1))), b - 0.5 * g.sum()
    return float(a), float(b - a * mid)


def sample(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC_SAMPLE, clean: int = CLEAN_SAMPLE, size: int = SAMPLE_BYTES) -> tuple[list[str], list[int]]:
    """Texts and labels to learn from, none held out: bounded by `toxic` and `clean` documents and `size` bytes of either kind.

    Documents are taken whole, in order of a hash of their doc_id. Of texts that share a doc_id that of the smallest hash is
    taken. The driver sees lengths first, at most one for each document, and then the texts of those that fit.
    """
    own = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(~held_out() & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).distinct()
    order = F.xxhash64("doc_id", F.lit(1))
    picked = own.where("toxic = 1").orderBy(order, "doc_id").limit(toxic).unionByName(own.where("toxic = 0").orderBy(order, "doc_id").limit(clean))
    picked = materialize(picked.withColumn("place", order), "sample")
    mark = F.xxhash64("text")
    found = docs.select("doc_id", "text").where("text is not null").join(small(picked, toxic + clean), "doc_id")
    least = found.groupBy("doc_id", "toxic", "place").agg(F.min(F.struct(mark.alias("mark"), F.octet_length("text").alias("bytes"))).alias("x"))
    held, fits = {0: 0, 1: 0}, []
    for r in sorted(least.select("doc_id", "toxic", "place", "x.*").collect(), key=lambda r: (r.place, r.doc_id)):
        if held[r.toxic] + r.bytes <= size:
            held[r.toxic] += r.bytes
            fits.append((r.doc_id, r.toxic, r.mark))
    if not fits:
        return [], []
    wanted = docs.sparkSession.createDataFrame(fits, "doc_id long, toxic int, mark long")
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(wanted.select("doc_id", "mark").distinct()), "doc_id").where(F.col("mark") == F.xxhash64("text"))
    texts = {r.doc_id: r.text for r in rows.groupBy("doc_id").agg(F.min("text").alias("text")).collect()}
    fits = sorted((d, y) for d, y, _ in fits)
    return [texts[d] for d, _ in fits], [y for _, y in fits]


def classify(docs: DataFrame, network: Network | None, *, score: str = "score", predicted: str = "predicted") -> DataFrame:
    """`docs` with score and predicted (1 from THRESHOLD on), which replace columns of those names.

    Null and empty texts score 0; without a network all do. Repeated rows each give a row. No shuffle.
    """
    rest = [f for f in docs.schema.fields if f.name not in (score, predicted)]
    names = [f.name for f in rest]
    if network is None:
        return docs.select(*names, F.lit(0.0).alias(score), F.lit(0).alias(predicted))
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value.scorer()
        for batch in batches:
            for part, texts in slices(batch, size=SLICE):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scorer.score(texts), pa.float64())], [*names, score])

    out = docs.select(*names).mapInArrow(run, StructType([*rest, StructField(score, DoubleType())]))
    return out.withColumn(predicted, (F.col(score) >= THRESHOLD).cast("int"))


def fit(docs: DataFrame, labels: DataFrame) -> Network | None:
    return train(*sample(docs, labels))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = classify(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def crc_held_out(doc_id: int) -> bool:
    """`held_out` for one id, in Python."""
    return zlib.crc32(str(doc_id).encode()) % 3 == 1
