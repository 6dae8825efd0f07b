"""Hashed text features and linear models that are trained here, for the classifiers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from tidewater.llm.common import MULT, bytes_of, mix, word_hashes

#: Bits of a feature's hash.
BITS = 26
#: Words of the classifiers end at any ASCII byte that is no letter or digit; other bytes belong to words.
APART = np.ones(256, bool)
APART[128:] = False
APART[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
ALPHA = np.zeros(256, np.uint8)
ALPHA[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
STATS = ("log_bytes", "letters", "digits", "marks", "capitals", "log_word", "lines")


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of texts: (text, feature) of each word and each 5-byte beginning of a longer word, and per text STATS."""
    data, at = bytes_of(column)
    n = len(at) - 1
    hashes, offsets, beginnings = word_hashes(data, at, apart=APART, beginnings=5)
    docs = np.repeat(np.arange(n), np.diff(offsets))
    some = beginnings != 0
    ids = np.concatenate([hashes, mix(beginnings[some] * MULT)]) >> np.uint64(64 - BITS)
    docs = np.concatenate([docs, docs[some]])
    size = np.diff(at).astype(float)
    sums = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[at])
    share = lambda flags: sums(flags) / np.maximum(size, 1)
    digits, lines = (data >= 48) & (data < 58), data == 10
    words = np.maximum(np.diff(offsets), 1)
    stats = [np.log1p(size) / 10, share(ALPHA[data]), share(digits), share((data > 32) & (data < 128) & (ALPHA[data] == 0) & ~digits), share((data >= 65) & (data < 91)), np.log1p(size / words) / 4, np.log1p(sums(lines)) / 5]
    return docs, ids.astype(np.int32), np.stack(stats, 1) if n else np.zeros((0, len(STATS)))


def pairs(docs: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature), by text."""
    both = np.unique(docs.astype(np.int64) << BITS | ids.astype(np.int64))
    return both >> BITS, (both & ((1 << BITS) - 1)).astype(np.int32)


def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, ...) -> (..., ids, stats): distinct features as int32 bytes. For the bounded training samples."""
    for batch in batches:
        docs, ids, stats = features(batch.column(0))
        docs, ids = pairs(docs, ids)
        cuts = np.searchsorted(docs, np.arange(batch.num_rows + 1))
        own = [ids[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        names = [*batch.schema.names[1:], "ids", "stats"]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(own, pa.binary()), pa.array([s.tobytes() for s in stats], pa.binary())], names)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35, dtype=x.dtype)))


@dataclass
class Rows:
    """A sparse matrix of ones at (row, column), beside dense columns and a last column of ones for the intercept."""

    row: np.ndarray
    column: np.ndarray
    width: int  # of the sparse part
    dense: np.ndarray

    @property
    def size(self) -> int:
        return self.width + self.dense.shape[1] + 1

    def __len__(self) -> int:
        return len(self.dense)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.column], minlength=len(self)) + self.dense @ w[self.width : -1] + w[-1]

    def back(self, v: np.ndarray) -> np.ndarray:
        """The transpose times v."""
        return np.concatenate([np.bincount(self.column, weights=v[self.row], minlength=self.width), self.dense.T @ v, [v.sum()]])

    def squared_back(self, v: np.ndarray) -> np.ndarray:
        """The transpose of the squares times v."""
        return np.concatenate([np.bincount(self.column, weights=v[self.row], minlength=self.width), (self.dense**2).T @ v, [v.sum()]])

    def take(self, which: np.ndarray) -> Rows:
        place = np.full(len(self), -1, np.int32)
        place[which] = np.arange(len(which), dtype=np.int32)
        some = place[self.row] >= 0
        return Rows(place[self.row[some]], self.column[some], self.width, self.dense[which])

    def beside(self, column: np.ndarray) -> Rows:
        return Rows(self.row, self.column, self.width, np.hstack([self.dense, column[:, None]]))

    def loss(self, w: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Log loss, gradient and the diagonal of the Hessian."""
        z = self.times(w)
        p = sigmoid(z)
        return float(np.sum(np.logaddexp(0, z) - y * z)), self.back(p - y), self.squared_back(p * (1 - p))


class Descent:
    """L-BFGS, told the loss and gradient at w, wherever they come from, until it is done."""

    def __init__(self, w: np.ndarray, l2: float, memory: int = 12, tolerance: float = 1e-5):
        self.w, self.memory, self.tolerance, self.done = w, memory, tolerance, False
        self.shrink = np.full(len(w), l2)
        self.shrink[-1] = 1e-3  # the intercept hardly shrinks
        self.base = self.grad = self.scale = self.step = None
        self.best, self.length, self.slope, self.pairs = np.inf, 1.0, 0.0, []

    def tell(self, loss: float, grad: np.ndarray, curve: np.ndarray) -> None:
        """Loss, gradient and Hessian's diagonal at w, without the penalty."""
        loss = loss + 0.5 * float(self.shrink @ (self.w * self.w))
        grad = grad + self.shrink * self.w
        if self.base is not None:
            if not loss <= self.best + 1e-4 * self.length * self.slope:  # too long a step
                self.length /= 2
                self.w, self.done = (self.base, True) if self.length < 1e-3 else (self.base + self.length * self.step, False)
                return
            s, y = self.w - self.base, grad - self.grad
            if s @ y > 1e-12:
                self.pairs = [*self.pairs, (s, y)][-self.memory :]
            if self.best - loss < self.tolerance * max(1.0, loss):
                self.done = True
                return
        self.base, self.grad, self.best = self.w, grad, loss
        self.scale = 1 / (curve + self.shrink)
        q, known = grad.copy(), []
        for s, y in reversed(self.pairs):
            a = (s @ q) / (s @ y)
            known.append(a)
            q -= a * y
        q *= self.scale
        if self.pairs:  # the diagonal alone takes features that go together for independent ones
            s, y = self.pairs[-1]
            q *= (s @ y) / (y @ (self.scale * y))
        for (s, y), a in zip(self.pairs, reversed(known), strict=True):
            q += (a - (y @ q) / (s @ y)) * s
        self.step, self.slope, self.length = -q, -float(grad @ q), 1.0
        self.w = self.base + self.step


def fit_logistic(x: Rows, y: np.ndarray, l2: float = 0.3, rounds: int = 200) -> np.ndarray:
    """Weights, the last one the intercept, of the least log loss + l2 / 2 * |w|**2."""
    found = Descent(np.zeros(x.size), l2)
    for _ in range(rounds):
        if found.done:
            break
        found.tell(*x.loss(found.w, y))
    return found.w if found.base is None or found.done else found.base


@dataclass
class Vocabulary:
    """The features a linear model reads: those associated with a label, by chi-squared with p < 0.001, in at least `least` texts; if there
    are more than `most`, those most associated."""

    chosen: np.ndarray  # ascending
    size: int

    @staticmethod
    def choose(lists: list[np.ndarray], labels: list[np.ndarray], most: int, least: int = 8) -> Vocabulary:
        flat = np.concatenate(lists) if lists else np.zeros(0, np.int32)
        names, seen = np.unique(flat, return_counts=True)
        names = names[(seen >= least) & (seen < max(len(lists), 1))]  # most are in a few texts
        at = np.searchsorted(names, flat)
        some = names[np.minimum(at, len(names) - 1)] == flat if len(names) else np.zeros(len(flat), bool)
        doc = np.repeat(np.arange(len(lists), dtype=np.int32), [len(x) for x in lists])[some]
        flat = at[some].astype(np.int32)
        del at, some
        seen = np.bincount(flat, minlength=len(names)).astype(float)
        best = np.zeros(len(names))
        n = max(len(lists), 1)
        for y in labels:
            with_y = np.bincount(flat, weights=y[doc].astype(float), minlength=len(names))
            rate = y.mean() if len(y) else 0
            gap = (with_y - seen * rate) ** 2 / np.maximum(seen * rate * (1 - rate) * (1 - seen / n), 1e-9)
            best = np.maximum(best, gap)
        top = np.argsort(-best, kind="stable")[:most]
        chosen = names[np.sort(top[best[top] > 10.8])]  # p < 0.001
        return Vocabulary(chosen, len(chosen))

    def columns(self, ids: np.ndarray) -> np.ndarray:
        """Where the features stand in the model; -1 for those not read."""
        if not self.size:
            return np.full(len(ids), -1)
        at = np.minimum(np.searchsorted(self.chosen, ids), self.size - 1)
        return np.where(self.chosen[at] == ids, at, -1)

    def rows(self, lists: list[np.ndarray], stats: np.ndarray) -> Rows:
        found = [np.unique(c[c >= 0]) for c in map(self.columns, lists)]
        row = np.repeat(np.arange(len(lists), dtype=np.int32), [len(c) for c in found])
        return Rows(row, (np.concatenate(found) if found else np.zeros(0)).astype(np.int32), self.size, stats.astype(float))

    def hits(self, docs: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, column) of a batch."""
        c = self.columns(ids)
        some = c >= 0
        return pairs(docs[some], c[some])

    def logits(self, docs: np.ndarray, columns: np.ndarray, stats: np.ndarray, w: np.ndarray) -> np.ndarray:
        return np.bincount(docs, weights=w[columns], minlength=len(stats)) + stats @ w[self.size : self.size + stats.shape[1]] + w[-1]


def unpacked(column: pa.ChunkedArray, kind: type) -> list[np.ndarray]:
    """Binary values as arrays that share the column's memory."""
    out = []
    for chunk in column.chunks:
        chunk = chunk.cast(pa.large_binary())
        _, offsets, data = chunk.buffers()
        at = np.frombuffer(offsets, np.int64)[chunk.offset : chunk.offset + len(chunk) + 1].tolist()
        flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        size = np.dtype(kind).itemsize
        out += [np.frombuffer(flat, kind, (b - a) // size, a) if b > a else np.zeros(0, kind) for a, b in zip(at[:-1], at[1:], strict=True)]
    return out

