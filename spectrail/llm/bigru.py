"""A bidirectional gated recurrent network with attention pooling over character and word inputs, in numpy.

A word's input is its own embedding (zero for words that were not in training) beside the mean of the embeddings of its
hashed character n-grams, the word's ends included. Both directions run over a window of words, attention weighs their
states, and the weighed state gives the window's logit.
"""

from __future__ import annotations

import numpy as np

WORD_DIM, CHAR_DIM, HIDDEN, ATTEND = 8, 12, 8, 8
GRAMS, GRAM_SIZES = 1 << 14, (3, 4, 5)
WINDOW, STRIDE = 32, 24
#: Part of the words whose own embedding a training step leaves out, and what a step keeps of all embeddings.
DROP, DECAY = 0.15, 1e-3
#: Words that a scorer remembers the input of; beyond this, or 200 bytes for each, it starts anew.
MEMORY = 150_000
#: A-Z become a-z; other ASCII but letters, digits and apostrophes becomes a space.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() or b == 0x27 else 0x20 for b in range(256))


def words(text: str) -> list[bytes]:
    return text.encode().translate(FOLD).split()


def grams(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram numbers of all words one after another, how many each word has)."""
    marked = [b"\x01" + w + b"\x02" for w in found]
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    raw = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
    word = np.repeat(np.arange(len(size)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(raw))
    number, owner = [], []
    for n in GRAM_SIZES:
        fits = np.flatnonzero(left >= n)
        h = np.full(len(fits), n, np.uint64)
        for j in range(n):
            h = (h ^ raw[fits + j]) * np.uint64(0x9E3779B97F4A7C15)
        number.append((h >> np.uint64(50)).astype(np.int64))
        owner.append(word[fits])
    number, owner = np.concatenate(number), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return number[order], np.bincount(owner, minlength=len(size))


def starts(n: int, window: int = WINDOW, stride: int = STRIDE) -> np.ndarray:
    """Where the overlapping windows of n words begin; the last one ends with the text."""
    if n <= window:
        return np.zeros(1, np.int64)
    return np.append(np.arange(0, n - window, stride), n - window)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Network:
    """p: the parameters by name. Wx, U, b: the gates z, r and n of the forward direction, then of the backward one."""

    def __init__(self, vocabulary: dict[bytes, int], seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        d = WORD_DIM + CHAR_DIM
        init = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[-2])).astype(np.float32)
        self.vocabulary = vocabulary
        self.p = {
            "words": (0.1 * rng.standard_normal((len(vocabulary) + 1, WORD_DIM))).astype(np.float32),
            "grams": (0.3 * rng.standard_normal((GRAMS, CHAR_DIM))).astype(np.float32),
            "Wx": init(2, d, 3 * HIDDEN), "U": init(2, HIDDEN, 3 * HIDDEN), "b": np.zeros((2, 3 * HIDDEN), np.float32),
            "Wa": init(2 * HIDDEN, ATTEND), "ba": np.zeros(ATTEND, np.float32), "va": init(ATTEND, 1)[:, 0],
            "wo": init(2 * HIDDEN, 1)[:, 0], "bo": np.zeros(1, np.float32),
        }
        self.p["words"][0] = 0
        self.scale, self.shift = 1.0, 0.0

    def scorer(self) -> Scorer:
        """One scorer a process, so that what it remembers serves later tasks."""
        if not hasattr(self, "_scorer"):
            self._scorer = Scorer(self)
        return self._scorer

    def inputs(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(input, word number, n-gram numbers, their counts) of different words."""
        number = np.fromiter((self.vocabulary.get(w, 0) for w in found), np.int64, len(found))
        gram, count = grams(found)
        begin = np.cumsum(count) - count
        sums = np.add.reduceat(self.p["grams"][gram], np.minimum(begin, max(0, len(gram) - 1)), axis=0) if len(gram) else np.zeros((len(found), CHAR_DIM), np.float32)
        sums[count == 0] = 0
        return np.concatenate([self.p["words"][number], sums / np.maximum(count, 1)[:, None].astype(np.float32)], 1), number, gram, count

    def forward(self, xs: np.ndarray, mask: np.ndarray | None, keep: list | None = None) -> np.ndarray:
        """Logits of windows. xs: (2, T, N, 3H) gate inputs of both directions, in their own order of time; mask: (T, N) of real words."""
        _, t, n, _ = xs.shape
        h2 = np.empty((t, n, 2 * HIDDEN), np.float32)
        for way in (0, 1):
            h = np.zeros((n, HIDDEN), np.float32)
            u = self.p["U"][way]
            for i in range(t):
                at = i if way == 0 else t - 1 - i
                x, g = xs[way, at], h @ u
                zr = _sigmoid(x[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                c = np.tanh(x[:, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
                new = c + z * (h - c)
                if mask is not None:
                    new = np.where(mask[at][:, None], new, h)
                if keep is not None:
                    keep.append((way, at, h, zr, c, g[:, 2 * HIDDEN :]))
                h = h2[at, :, way * HIDDEN : (way + 1) * HIDDEN] = new
        a = np.tanh(h2.reshape(t * n, -1) @ self.p["Wa"] + self.p["ba"])
        e = (a @ self.p["va"]).reshape(t, n)
        if mask is not None:
            e = np.where(mask, e, -1e9)
        w = np.exp(e - e.max(axis=0))
        w /= w.sum(axis=0)
        s = np.einsum("tn,tnh->nh", w, h2)
        if keep is not None:
            keep.append((h2, a, w, s))
        return s @ self.p["wo"] + self.p["bo"][0]

    def gradients(self, found: list[bytes], ids: np.ndarray, mask: np.ndarray, label: np.ndarray, rng: np.random.Generator | None = None) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy and its gradients. ids: (T, N) places in `found`. With rng, some words go without their own embedding."""
        x, number, gram, count = self.inputs(found)
        if rng is not None:
            gone = rng.random(len(found)) < DROP
            x[gone, :WORD_DIM] = 0
            number = np.where(gone, 0, number)
        gates = np.stack([x @ self.p["Wx"][w] + self.p["b"][w] for w in (0, 1)])
        keep: list = []
        logit = self.forward(gates[:, ids], mask, keep)
        loss = float(np.mean(np.logaddexp(0, logit) - label * logit))
        d = (_sigmoid(logit) - label) / len(label)
        h2, a, w, s = keep.pop()
        t, n = ids.shape
        out = {k: np.zeros_like(v) for k, v in self.p.items()}
        out["wo"], out["bo"] = s.T @ d, np.array([d.sum()], np.float32)
        ds = d[:, None] * self.p["wo"]
        dh = w[:, :, None] * ds
        dw = np.einsum("tnh,nh->tn", h2, ds)
        de = (w * (dw - (w * dw).sum(axis=0))).reshape(-1)
        da = de[:, None] * self.p["va"] * (1 - a * a)
        out["va"], out["Wa"], out["ba"] = a.T @ de, h2.reshape(t * n, -1).T @ da, da.sum(axis=0)
        dh = dh + (da @ self.p["Wa"].T).reshape(t, n, -1)
        dgates = np.zeros_like(gates)
        for way in (1, 0):
            carried = np.zeros((n, HIDDEN), np.float32)
            u, du = self.p["U"][way], out["U"][way]
            for i in range(t - 1, -1, -1):
                _, at, h, zr, c, gn = keep.pop()
                g = dh[at, :, way * HIDDEN : (way + 1) * HIDDEN] + carried
                on = mask[at][:, None]
                real = np.where(on, g, 0)
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                dc = real * (1 - z) * (1 - c * c)
                dz = real * (h - c) * z * (1 - z)
                dr = dc * gn * r * (1 - r)
                side = np.concatenate([dz, dr, dc * r], 1)
                np.add.at(dgates[way], ids[at], np.concatenate([dz, dr, dc], 1))
                du += h.T @ side
                carried = np.where(on, real * z, g) + side @ u.T
        dx = np.zeros_like(x)
        for way in (0, 1):
            out["Wx"][way], out["b"][way] = x.T @ dgates[way], dgates[way].sum(axis=0)
            dx += dgates[way] @ self.p["Wx"][way].T
        np.add.at(out["words"], number, dx[:, :WORD_DIM])
        out["words"][0] = 0
        np.add.at(out["grams"], gram, np.repeat(dx[:, WORD_DIM:] / np.maximum(count, 1)[:, None], count, axis=0))
        return loss, {k: v.astype(np.float32) for k, v in out.items()}


class Adam:
    def __init__(self, p: dict[str, np.ndarray], rate: float) -> None:
        self.rate, self.step = rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))

    def apply(self, p: dict[str, np.ndarray], g: dict[str, np.ndarray]) -> None:
        self.step += 1
        for k, x in p.items():
            self.m[k] += 0.1 * (g[k] - self.m[k])
            self.v[k] += 0.01 * (g[k] * g[k] - self.v[k])
            if k in ("words", "grams"):
                x *= 1 - DECAY
            x -= self.rate * (self.m[k] / (1 - 0.9**self.step)) / (np.sqrt(self.v[k] / (1 - 0.99**self.step)) + 1e-7)


class Scorer:
    """Scores texts with a network; remembers the gate inputs of words it has met."""

    def __init__(self, network: Network) -> None:
        self.net = network
        self._forget()

    def _forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.held = 0
        self.gates = np.zeros((2, 1024, 3 * HIDDEN), np.float32)

    def ids(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.place.__getitem__, found), np.int64, len(found))

    def learn(self, different: set[bytes]) -> None:
        if len(self.place) > MEMORY or self.held > 200 * MEMORY:
            self._forget()
        new = [w for w in different if w not in self.place]
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            x = self.net.inputs(some)[0]
            first = len(self.place) + 1  # place 0 pads
            while first + len(some) > self.gates.shape[1]:
                self.gates = np.concatenate([self.gates, np.zeros_like(self.gates)], axis=1)
            for way in (0, 1):
                self.gates[way, first : first + len(some)] = x @ self.net.p["Wx"][way] + self.net.p["b"][way]
            self.place.update(zip(some, range(first, first + len(some))))
            self.held += sum(map(len, some))

    def windows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, begin, logit) of all windows of the texts that have words."""
        found = [words(t) for t in texts]
        self.learn(set().union(*found))
        size = np.array([len(w) for w in found])
        flat = np.concatenate([self.ids(w) for w in found] + [np.zeros(WINDOW, np.int64)])
        base = np.cumsum(size) - size
        own = [starts(n) if n else np.zeros(0, np.int64) for n in size.tolist()]
        text = np.repeat(np.arange(len(texts)), [len(o) for o in own])
        begin = np.concatenate([*own, np.zeros(0, np.int64)])
        logit = np.zeros(len(text), np.float32)
        short = size[text] < WINDOW
        for which, masked in ((np.flatnonzero(~short), False), (np.flatnonzero(short), True)):
            for at in range(0, len(which), 2048):
                some = which[at : at + 2048]
                ids = flat[(base[text[some]] + begin[some]) + np.arange(WINDOW)[:, None]]
                mask = np.arange(WINDOW)[:, None] < size[text[some]] if masked else None
                logit[some] = self.net.forward(self.gates[:, np.where(mask, ids, 0) if masked else ids], mask)
        return text, begin, logit

    def score(self, texts: list[str]) -> np.ndarray:
        """0 to 1; a text without words scores 0."""
        text, _, logit = self.windows(texts)
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, text, logit)
        return _sigmoid(np.where(np.isinf(best), -100.0, self.net.scale * best + self.net.shift))
