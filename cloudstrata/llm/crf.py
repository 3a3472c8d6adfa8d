"""Linear-chain conditional random field over dense features, in NumPy.

Sequences of any lengths are worked on together: they are sorted by length, and
step t handles those that are longer than t. Fitting maximises the penalised
log-likelihood by Adam over all sequences at once.
"""

from __future__ import annotations

import numpy as np


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis))


class Chains:
    """Sequences laid out by time: rows `order[offset[t] : offset[t] + active[t]]` are the t-th of each sequence that has one."""

    def __init__(self, lengths: np.ndarray):
        lengths = np.asarray(lengths, np.int64)
        begin = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else np.zeros(0, np.int64)
        rank = np.argsort(-lengths, kind="stable")
        self.begin, self.lengths = begin[rank], lengths[rank]
        self.steps = int(lengths.max()) if len(lengths) else 0
        self.active = np.searchsorted(-self.lengths, -np.arange(self.steps), side="left")
        self.total = int(lengths.sum())
        self.last = self.begin[self.lengths > 0] + self.lengths[self.lengths > 0] - 1

    def at(self, t: int) -> np.ndarray:
        return self.begin[: self.active[t]] + t


class LinearChainCrf:
    """weights: features x states; moves: states x states; ends: scores of the first and last state."""

    def __init__(self, states: int, features: int):
        self.states = states
        self.weights = np.zeros((features, states))
        self.moves = np.zeros((states, states))
        self.ends = np.zeros((2, states))

    def _forward_backward(self, emit: np.ndarray, chains: Chains) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        alpha, beta = np.zeros_like(emit), np.zeros_like(emit)
        first = chains.at(0)
        alpha[first] = emit[first] + self.ends[0]
        for t in range(1, chains.steps):
            now = chains.at(t)
            alpha[now] = emit[now] + _lse(alpha[now - 1][:, :, None] + self.moves, 1)
        beta[chains.last] = self.ends[1]
        for t in range(chains.steps - 1, 0, -1):
            now = chains.at(t)
            beta[now - 1] = _lse(self.moves + (emit[now] + beta[now])[:, None, :], 2)
        total = _lse(alpha[first] + beta[first], 1)  # of each sequence, longest first
        return alpha, beta, total

    def _per_row(self, total: np.ndarray, chains: Chains) -> np.ndarray:
        out = np.zeros(chains.total)
        for t in range(chains.steps):
            now = chains.at(t)
            out[now] = total[: len(now)]
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, lengths: np.ndarray, rounds: int = 150, rate: float = 0.08, l2: float = 1e-3) -> LinearChainCrf:
        """y: states by row. l2: per row."""
        chains = Chains(lengths)
        n = max(1, chains.total)
        if not chains.total:
            return self
        onehot = np.eye(self.states)[y]
        inner = np.concatenate([chains.at(t) for t in range(1, chains.steps)]) if chains.steps > 1 else np.zeros(0, np.int64)
        first = chains.at(0)
        seen_moves = onehot[inner - 1].T @ onehot[inner]
        params = [self.weights, self.moves, self.ends]
        mean, var = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for k in range(1, rounds + 1):
            emit = x @ self.weights
            alpha, beta, total = self._forward_backward(emit, chains)
            z = self._per_row(total, chains)
            p = np.exp(alpha + beta - z[:, None])
            pair = np.exp(alpha[inner - 1][:, :, None] + self.moves + (emit[inner] + beta[inner])[:, None, :] - z[inner][:, None, None]).sum(0)
            grads = [
                x.T @ (onehot - p) / n - l2 * self.weights,
                (seen_moves - pair) / n - l2 * self.moves,
                np.stack([(onehot[first] - p[first]).sum(0), (onehot[chains.last] - p[chains.last]).sum(0)]) / n - l2 * self.ends,
            ]
            for v, g, m, s in zip(params, grads, mean, var, strict=True):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                v += rate * (m / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.99**k)) + 1e-8)
        return self

    def marginals(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The probability of each state at each row."""
        chains = Chains(lengths)
        if not chains.total:
            return np.zeros((0, self.states))
        alpha, beta, total = self._forward_backward(x @ self.weights, chains)
        return np.exp(alpha + beta - self._per_row(total, chains)[:, None])

    def viterbi(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The states of the most probable sequences; of equal ones the lower states."""
        chains = Chains(lengths)
        out = np.zeros(chains.total, np.int64)
        if not chains.total:
            return out
        emit = x @ self.weights
        best, back = np.zeros_like(emit), np.zeros(emit.shape, np.int64)
        first = chains.at(0)
        best[first] = emit[first] + self.ends[0]
        for t in range(1, chains.steps):
            now = chains.at(t)
            come = best[now - 1][:, :, None] + self.moves
            back[now] = come.argmax(1)
            best[now] = emit[now] + come.max(1)
        out[chains.last] = (best[chains.last] + self.ends[1]).argmax(1)
        for t in range(chains.steps - 1, 0, -1):
            now = chains.at(t)
            out[now - 1] = back[now, out[now]]
        return out
