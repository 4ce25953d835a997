"""A linear-chain conditional random field in numpy: log-likelihood training, Viterbi in batches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class LinearChainCRF:
    """Scores of a sequence: weights of each token's features for its label, and of each step between labels."""

    def __init__(self, labels: Sequence[str], features: Callable[[Sequence[str]], list[list[str]]]):
        self.labels, self.features = list(labels), features
        self.index: dict[str, int] = {}
        self.emit = np.zeros((0, len(labels)))
        self.step = np.zeros((len(labels), len(labels)))
        self.first = np.zeros(len(labels))

    def _ids(self, tokens: Sequence[str], grow: bool) -> list[list[int]]:
        if grow:
            return [[self.index.setdefault(f, len(self.index)) for f in fs] for fs in self.features(tokens)]
        return [[i for f in fs if (i := self.index.get(f)) is not None] for fs in self.features(tokens)]

    def fit(self, rows: Sequence[tuple[Sequence[str], Sequence[str]]], epochs: int = 60, rate: float = 0.3, l2: float = 1e-3) -> LinearChainCRF:
        """Ascends the log-likelihood by Adagrad over whole passes of the labelled rows, in their order."""
        number = {x: i for i, x in enumerate(self.labels)}
        data = [(self._ids(t, True), [number[y] for y in ys]) for t, ys in rows]
        n = len(self.labels)
        self.emit = np.zeros((len(self.index), n))
        sums = [np.full(x.shape, 1e-6) for x in (self.emit, self.step, self.first)]
        for _ in range(epochs):
            grads = [-l2 * x * len(data) / 50 for x in (self.emit, self.step, self.first)]
            for ids, ys in data:
                scores = np.array([self.emit[f].sum(axis=0) for f in ids])
                t = len(ys)
                ahead, back = np.zeros((t, n)), np.zeros((t, n))
                ahead[0] = self.first + scores[0]
                for k in range(1, t):
                    ahead[k] = _log_sum(ahead[k - 1][:, None] + self.step, 0) + scores[k]
                for k in range(t - 2, -1, -1):
                    back[k] = _log_sum(self.step + (scores[k + 1] + back[k + 1])[None, :], 1)
                whole = _log_sum(ahead[-1], 0)
                own = -np.exp(ahead + back - whole)
                for k, y in enumerate(ys):
                    own[k, y] += 1
                grads[2] += own[0]
                for k in range(t):
                    np.add.at(grads[0], ids[k], own[k])
                    if k:
                        both = ahead[k - 1][:, None] + self.step + (scores[k] + back[k])[None, :] - whole
                        grads[1] -= np.exp(both)
                        grads[1][ys[k - 1], ys[k]] += 1
            for x, g, s in zip((self.emit, self.step, self.first), grads, sums, strict=True):
                s += g * g
                x += rate * g / np.sqrt(s)
        return self

    def scores(self, tokens: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(tokens), len(self.labels)))
        for k, ids in enumerate(self._ids(tokens, False)):
            if ids:
                out[k] = self.emit[ids].sum(axis=0)
        return out

    def decode(self, rows: list[np.ndarray], cells: int = 1 << 20) -> list[np.ndarray]:
        """The best labels of each row of scores: rows of similar length are padded to one batch of bounded size."""
        out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(rows)
        order = sorted((i for i in range(len(rows)) if len(rows[i])), key=lambda i: len(rows[i]))
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and (end - at + 1) * len(rows[order[end]]) <= cells:
                end += 1
            group = order[at:end]
            at = end
            longest = len(rows[group[-1]])
            padded = np.zeros((longest, len(group), len(self.labels)))
            lengths = np.array([len(rows[i]) for i in group])
            for k, i in enumerate(group):
                padded[: lengths[k], k] = rows[i]
            best = self.first + padded[0]
            came = np.zeros((longest, len(group), len(self.labels)), np.int8)
            last = best.copy()
            for t in range(1, longest):
                paths = best[:, :, None] + self.step[None]
                came[t] = paths.argmax(axis=1)
                best = paths.max(axis=1) + padded[t]
                live = lengths > t
                last[live] = best[live]
            labels = np.zeros((longest, len(group)), np.int8)
            now = last.argmax(axis=1)
            for t in range(longest - 1, -1, -1):
                here = lengths > t
                labels[t, here] = now[here]
                if t:
                    now = np.where(here, came[t, np.arange(len(group)), now], now)
            for k, i in enumerate(group):
                out[i] = labels[: lengths[k], k]
        return out
