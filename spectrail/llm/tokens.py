"""Token counts and token ids for a byte-level BPE vocabulary file of the tokenizers library.

Texts are cut at single spaces and newlines before the library sees them. Its pre-tokenizer never lets a token cross
such a cut, if a space or newline stands alone between other characters: a space goes to the word behind it, a newline
becomes a token of its own. So a text's tokens are those of its chunks, and a chunk met before is looked up. Texts with
other white space, several in a row, white space at an end, or the string of a special token go to the library whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrail.ship import ship

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512
#: Bytes, about, that each of a Python worker's memories takes; beyond this it forgets all but the short chunks, or all if that
#: is too little. Chunks of more than LONGEST characters are never remembered.
MEMORY, LONGEST, OVERHEAD = 160_000_000, 64, 150
#: Texts of about this many bytes are handled at a time.
SLICE = 4_000_000

#: Leads the first chunk of a text, the only one without a space before it; no other chunk holds a space.
FIRST = " "

SPACE = re.compile(r"\s")

_loaded: dict = {}
_kept: dict = {}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _load(path: str):
    """The library's tokenizer and its special strings, once a process."""
    if path not in _loaded:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        if tok.normalizer is not None or type(tok.model).__name__ != "BPE" or type(tok.pre_tokenizer).__name__ != "ByteLevel":
            raise ValueError(f"{path}: only byte-level BPE without a normalizer can be counted and encoded by chunks")
        if any(t.lstrip or t.rstrip or t.single_word for t in tok.get_added_tokens_decoder().values()):
            raise ValueError(f"{path}: an added token that takes its surroundings with it can't be told apart by chunks")
        _loaded[path] = tok, tuple(t.content for t in tok.get_added_tokens_decoder().values())
    return _loaded[path]


def vocabulary_size(path: str) -> int:
    return _load(path)[0].get_vocab_size()


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, and that byte."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


def whole_tokens(path: str) -> frozenset[str]:
    """The vocabulary strings, in byte letters, proved to be one token: merging one alone gives just itself.

    Done once on the driver, before any text is read; the set is no larger than the vocabulary.
    """
    tok, special = _load(path)
    model = tok.model
    proved = []
    for text, number in tok.get_vocab(with_added_tokens=False).items():
        if text not in special:
            got = model.tokenize(text)
            if len(got) == 1 and got[0].id == number:
                proved.append(text)
    return frozenset(proved)


def _clean(chunk: str, special: tuple[str, ...]) -> bool:
    """Whether the chunk (a newline, or the mark of a first chunk, may lead it) is free of white space and special strings."""
    body = chunk[1:] if chunk[:1] in ("\n", FIRST) else chunk
    return bool(body) and SPACE.search(body) is None and not any(s in chunk for s in special)


class _Known(dict):
    """What a worker has learnt, with the bytes that it takes, about. Long keys, and what passes MEMORY, are not kept."""

    held = 0

    def learn(self, key: str, value) -> None:
        if len(key) <= LONGEST:
            self.held += OVERHEAD + len(key) + (len(value) if isinstance(value, bytes) else 0)
            self[key] = value

    def trim(self) -> None:
        if self.held > MEMORY:
            short = [(k, v) for k, v in self.items() if len(k) <= 8]
            self.clear()
            self.held = 0
            if len(short) * OVERHEAD <= MEMORY // 2:
                for k, v in short:
                    self.learn(k, v)


class _Chunks:
    """Looks texts up chunk by chunk. learn(list of clean chunks) -> their values, in order."""

    def __init__(self, special: tuple[str, ...], learn) -> None:
        self.special, self.learn = special, learn
        self.known = _Known()

    def values(self, texts: list[str]) -> list[list | None]:
        """The values of each text's chunks, in order; None for a text that must be handled whole.

        The texts' own chunks hold no space; a text that begins with a newline has an empty first chunk.
        """
        self.known.trim()
        get, out = self.known.get, []
        open_: list[tuple[list[str], list, list[int]]] = []
        new: set[str] = set()
        for text in texts:
            chunks = (" " + text).replace("\n", " \n").split(" ")[1:] if text else []
            if chunks and chunks[0]:
                chunks[0] = FIRST + chunks[0]
            found = list(map(get, chunks))
            out.append(found)
            if None in found:
                at = [i for i, v in enumerate(found) if v is None]
                open_.append((chunks, found, at))
                new.update([chunks[i] for i in at])
        fresh = [c for c in new if _clean(c, self.special)]
        learnt = dict(zip(fresh, self.learn(fresh), strict=True))
        for c, v in learnt.items():
            self.known.learn(c, v)
        for chunks, found, at in open_:
            for i in at:
                found[i] = learnt.get(chunks[i])
        return [None if None in found else found for found in out]


def _joined(chunks: list[str]) -> tuple[str, np.ndarray]:
    """The chunks one after another as they stand in a text, and where each ends, in characters."""
    parts = [c if c[:1] == "\n" else " " + c for c in chunks]
    return "".join(parts), np.cumsum([len(p) for p in parts])


def _leads(fresh: list[str]) -> tuple[list[int], list[int]]:
    lead = [i for i, c in enumerate(fresh) if c[:1] == FIRST]
    return lead, [i for i, c in enumerate(fresh) if c[:1] != FIRST]


def kept(make, *key):
    """make(*key), once a Python worker: what it has learnt serves the worker's later tasks too. One object at a time."""
    if (make, key) not in _kept:
        _kept.clear()
        _kept[make, key] = make(*key)
    return _kept[make, key]


class Counter:
    """Counts tokens: pre-tokens that are whole tokens directly, the rest by merging them."""

    def __init__(self, path: str, whole: frozenset[str]) -> None:
        self.tok, self.special = _load(path)
        self.whole, self.split, self.model = whole, self.tok.pre_tokenizer.pre_tokenize_str, self.tok.model
        self.merged = _Known()
        self.chunks = _Chunks(self.special, self._learn)

    def _piece(self, piece: str) -> int:
        if piece in self.whole:
            return 1
        if (n := self.merged.get(piece)) is None:
            self.merged.trim()
            n = len(self.model.tokenize(piece))
            self.merged.learn(piece, n)
        return n

    def _plain(self, text: str) -> int:
        return sum(self._piece(p) for p, _ in self.split(text)) if text else 0

    def _learn(self, fresh: list[str]) -> list[int]:
        lead, rest = _leads(fresh)
        out = [0] * len(fresh)
        for i in lead:
            out[i] = self._plain(fresh[i][1:])
        if rest:
            text, ends = _joined([fresh[i] for i in rest])
            pieces = self.split(text)
            at = np.searchsorted(ends, np.fromiter((e for _, (_, e) in pieces), np.int64, len(pieces)))
            counts = np.fromiter((self._piece(p) for p, _ in pieces), np.int64, len(pieces))
            for i, n in zip(rest, np.bincount(at, counts, len(rest)).astype(np.int64).tolist(), strict=True):
                out[i] = n
        return out

    def _whole_text(self, text: str) -> int:
        """A special string inside the text is one token, as the library has it by default; what lies between is plain."""
        parts = [text]
        n = 0
        for s in self.special:
            n += sum(p.count(s) for p in parts)
            parts = [q for p in parts for q in p.split(s)]
        return n + sum(self._plain(p) for p in parts)

    def count(self, texts: list[str]) -> list[int]:
        return [sum(v) if v is not None else self._whole_text(t) for t, v in zip(texts, self.chunks.values(texts), strict=True)]


def kind_for(ids: int) -> str:
    return "<u2" if ids <= 1 << 16 else "<u4"


class Encoder:
    """Gives the token ids of texts as little-endian unsigned integers of type `kind`: the smallest that holds the vocabulary."""

    def __init__(self, path: str) -> None:
        self.tok, self.special = _load(path)
        letters = byte_letters()
        self.kind = np.dtype(kind_for(self.tok.get_vocab_size()))
        self.lengths = np.zeros(self.tok.get_vocab_size(), np.int64)
        for text, number in self.tok.get_vocab(with_added_tokens=False).items():
            if all(c in letters for c in text):
                self.lengths[number] = len(text)
        self.chunks = _Chunks(self.special, self._learn)

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, self.kind).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, fresh: list[str]) -> list[bytes]:
        """Chunks are encoded many at a time; the lengths of the tokens in bytes tell where each chunk's ids end."""
        lead, rest = _leads(fresh)
        out = [b""] * len(fresh)
        for i, ids in zip(lead, self._ids([fresh[i][1:] for i in lead]), strict=True):
            out[i] = ids
        for at in range(0, len(rest), 2000):
            some = rest[at : at + 2000]
            parts = [c if (c := fresh[i])[:1] == "\n" else " " + c for i in some]
            ids = self._ids(["".join(parts)])[0]
            ends = np.cumsum(self.lengths[np.frombuffer(ids, self.kind)])
            wanted = np.cumsum([len(p.encode()) for p in parts])
            cuts = np.searchsorted(ends, wanted) + 1
            if not np.array_equal(ends[cuts - 1], wanted):
                raise ValueError("a token crosses the space between two chunks; this vocabulary can't be used by chunks")
            begin = 0
            for i, end in zip(some, cuts.tolist(), strict=True):
                out[i] = ids[self.kind.itemsize * begin : self.kind.itemsize * end]
                begin = end
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        return [b"".join(v) if v is not None else self._ids([t])[0] for t, v in zip(texts, self.chunks.values(texts), strict=True)]


def slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """The batch in runs of about `size` bytes of text, with the texts (null: empty); only a run's texts become Python's."""
    held = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    begin = 0
    while begin < len(held):
        used = held[begin - 1] if begin else 0
        end = min(len(held), int(np.searchsorted(held, used + size)) + 1)
        part = batch.slice(begin, end - begin)
        yield part, [t or "" for t in part.column(column).to_pylist()]
        begin = end


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every document.

    Null and empty texts have no bytes and no tokens. Repeated rows each give a row. No shuffle.
    """
    path = path or tokenizer_path()
    ship(docs.sparkSession)
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = kept(Counter, path, whole.value)
        for batch in batches:
            for part, texts in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), pa.array(counter.count(texts), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    out = rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
