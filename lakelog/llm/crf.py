"""Linear-chain conditional random field with two tags, 0 and 1.

A chain's score is the sum of its tags' emissions (tag 0 has emission 0, tag 1 the weights
of the position's features and a bias), of its transitions and of its start.  With two tags
the forward and backward messages are single odds, so all chains of a batch advance
together, one numpy step for each position of the longest.
"""

from __future__ import annotations

import numpy as np


class Chains:
    """Chains of positions ``first[i]:first[i+1]``, in steps over all that are long enough."""

    def __init__(self, first: np.ndarray):
        length = np.diff(first)
        order = np.argsort(-length, kind="stable")
        order = order[length[order] > 0]
        self.start, self.length = first[:-1][order], length[order]
        self.longest = int(self.length[0]) if len(order) else 0
        # lanes with more than t positions
        self.active = np.searchsorted(-self.length, -np.arange(self.longest), "left") if self.longest else np.zeros(0, int)

    def at(self, t: int) -> np.ndarray:
        return self.start[: self.active[t]] + t


class Crf:
    """``weights[0]`` belongs to absent features and stays 0."""

    def __init__(self, n_features: int):
        self.weights = np.zeros(n_features)
        self.bias = 0.0
        self.start = 0.0
        self.move = np.zeros((2, 2))

    def emissions(self, features: np.ndarray) -> np.ndarray:
        """``features``: an index per position and feature, 0 where absent."""
        out = np.full(len(features), float(self.bias))
        for k in range(features.shape[1]):
            out += self.weights[features[:, k]]
        return out

    def _messages(self, emit: np.ndarray, chains: Chains) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a = np.exp(self.move)
        e = np.exp(np.clip(emit, -30, 30))
        fwd, bwd = np.empty(len(e)), np.ones(len(e))
        for t in range(chains.longest):
            i = chains.at(t)
            if t:
                o = fwd[i - 1]
                fwd[i] = np.clip(e[i] * (a[0, 1] + o * a[1, 1]) / (a[0, 0] + o * a[1, 0]), 1e-30, 1e30)
            else:
                fwd[i] = e[i] * np.exp(self.start)
        for t in range(chains.longest - 2, -1, -1):
            i = chains.at(t + 1) - 1
            o = e[i + 1] * bwd[i + 1]
            bwd[i] = (a[1, 0] + a[1, 1] * o) / (a[0, 0] + a[0, 1] * o)
        return e, fwd, bwd

    def marginals(self, emit: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The probability of tag 1 at each position."""
        _, fwd, bwd = self._messages(emit, Chains(first))
        o = fwd * bwd
        return o / (1 + o)

    def viterbi(self, emit: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The best tags; of equal ones, 0."""
        chains = Chains(first)
        m = self.move
        # best score of tag 1 less that of tag 0, and where each tag came from
        diff = np.empty(len(emit))
        back = np.zeros((2, len(emit)), np.int8)
        for t in range(chains.longest):
            i = chains.at(t)
            if t:
                d = diff[i - 1]
                to0, to1 = d + m[1, 0] > m[0, 0], d + m[1, 1] > m[0, 1]
                back[0, i], back[1, i] = to0, to1
                diff[i] = emit[i] + np.where(to1, d + m[1, 1], m[0, 1]) - np.where(to0, d + m[1, 0], m[0, 0])
            else:
                diff[i] = emit[i] + self.start
        tags = np.zeros(len(emit), np.int8)
        for t in range(chains.longest - 1, -1, -1):
            i = chains.at(t)
            going = len(chains.at(t + 1)) if t + 1 < chains.longest else 0
            tags[i[going:]] = diff[i[going:]] > 0
            nxt = i[:going] + 1
            tags[i[:going]] = back[tags[nxt], nxt]
        return tags

    def fit(self, features: np.ndarray, tags: np.ndarray, first: np.ndarray, epochs: int = 30, rate: float = 0.5, l2: float = 1e-3) -> "Crf":
        """Maximise the likelihood of the tags by Adam over all chains; deterministic."""
        chains = Chains(first)
        columns = np.ascontiguousarray(features.T)
        inner = np.ones(len(tags), bool)
        inner[first[:-1][np.diff(first) > 0]] = False
        later = np.flatnonzero(inner)
        heads = first[:-1][np.diff(first) > 0]
        seen = np.zeros((2, 2))
        np.add.at(seen, (tags[later - 1], tags[later]), 1)
        size = len(self.weights) + 6
        m, v = np.zeros(size), np.zeros(size)
        scale = max(int(tags.sum()), 1)
        for step in range(1, epochs + 1):
            e, fwd, bwd = self._messages(self.emissions(columns.T), chains)
            o = fwd * bwd
            error = tags - o / (1 + o)
            flat = np.zeros(len(self.weights))
            for column in columns:
                flat += np.bincount(column, weights=error, minlength=len(self.weights))
            a = np.exp(self.move)
            f, b = fwd[later - 1], e[later] * bwd[later]
            z = 1 / (a[0, 0] + a[0, 1] * b + a[1, 0] * f + a[1, 1] * f * b)
            expected = np.array([[a[0, 0] * z.sum(), a[0, 1] * (b * z).sum()], [a[1, 0] * (f * z).sum(), a[1, 1] * (f * b * z).sum()]])
            grad = np.concatenate([flat, [error.sum(), error[heads].sum()], (seen - expected).ravel()]) / scale
            theta = np.concatenate([self.weights, [self.bias, self.start], self.move.ravel()])
            grad[:-6] -= l2 * theta[:-6]
            grad[0] = 0.0
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            self.weights, self.bias, self.start, self.move = theta[:-6], theta[-6], theta[-5], theta[-4:].reshape(2, 2)
        return self
