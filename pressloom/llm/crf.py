"""A linear-chain conditional random field with two labels, in numpy.

Label 1 of a position scores ``x @ weights + bias``, label 0 scores zero; ``transition[i, j]`` scores label j after
label i. Chains of a call are padded to one array, so the recursions step over positions, not over chains.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def padded(values: Sequence[np.ndarray], fill: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(chains x longest) array and the mask of real positions."""
    longest = max((len(v) for v in values), default=0)
    out = np.full((len(values), longest), fill)
    mask = np.zeros((len(values), longest), bool)
    for i, v in enumerate(values):
        out[i, : len(v)] = v
        mask[i, : len(v)] = True
    return out, mask


def _pair(scores: np.ndarray) -> np.ndarray:
    """Log of the summed exponentials over the last axis."""
    top = scores.max(-1, keepdims=True)
    return np.log(np.exp(scores - top).sum(-1)) + top[..., 0]


class Chain:
    def __init__(self, features: int):
        self.weights, self.bias, self.transition = np.zeros(features), 0.0, np.zeros((2, 2))

    def emission(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias

    def _forward_backward(self, emission: np.ndarray, mask: np.ndarray):
        chains, length = emission.shape
        e = np.stack((np.zeros_like(emission), emission), -1)
        ahead, behind = np.zeros((chains, length, 2)), np.zeros((chains, length, 2))
        ahead[:, 0] = e[:, 0]
        for i in range(1, length):
            step = e[:, i] + _pair((ahead[:, i - 1, :, None] + self.transition).swapaxes(1, 2))
            ahead[:, i] = np.where(mask[:, i, None], step, ahead[:, i - 1])
        for i in range(length - 2, -1, -1):
            step = _pair(self.transition + (e[:, i + 1] + behind[:, i + 1])[:, None, :])
            behind[:, i] = np.where(mask[:, i + 1, None], step, behind[:, i + 1])
        total = _pair(ahead[:, -1])
        return e, ahead, behind, total

    def marginals(self, emissions: Sequence[np.ndarray]) -> list[np.ndarray]:
        """Per chain the probability of label 1 at each position."""
        out: list[np.ndarray] = [np.zeros(0)] * len(emissions)
        order = sorted(range(len(emissions)), key=lambda i: len(emissions[i]))
        for at in range(0, len(order), 64):  # chains of like length together
            some = order[at : at + 64]
            scores, mask = padded([emissions[i] for i in some])
            if not scores.shape[1]:
                continue
            _, ahead, behind, total = self._forward_backward(scores, mask)
            share = np.exp(np.minimum(0, ahead[..., 1] + behind[..., 1] - total[:, None]))
            for row, i in enumerate(some):
                out[i] = share[row, : len(emissions[i])]
        return out

    def best(self, emission: np.ndarray) -> list[int]:
        """Viterbi labels of one chain."""
        (t00, t01), (t10, t11) = self.transition.tolist()
        back, zero, one = [], 0.0, 0.0
        for i, e in enumerate(emission.tolist()):
            if i:
                z0, z1 = zero + t00, one + t10
                o0, o1 = zero + t01, one + t11
                back.append((z1 > z0, o1 > o0))
                zero, one = max(z0, z1), max(o0, o1) + e
            else:
                one = e
        labels = [int(one > zero)] if len(emission) else []
        for choice in reversed(back):
            labels.append(int(choice[labels[-1]]))
        return labels[::-1]

    def fit(self, chains: Sequence[tuple[np.ndarray, np.ndarray]], steps: int = 100, rate: float = 0.1, l2: float = 1e-4) -> "Chain":
        """Maximise the penalised likelihood of labelled chains by Adam on all of them at once."""
        chains = [c for c in chains if len(c[1])]
        if not chains:
            return self
        labels, mask = padded([y for _, y in chains])
        labels = labels.astype(int)
        x = np.zeros((*mask.shape, len(self.weights)), np.float32)
        for i, (rows, _) in enumerate(chains):
            x[i, : len(rows)] = rows
        positions = mask.sum()
        both = (mask[:, 1:] & mask[:, :-1])[..., None, None]
        seen = ((labels[:, :-1, None, None] == np.arange(2)[:, None]) & (labels[:, 1:, None, None] == np.arange(2)) & both).sum((0, 1))
        params = np.concatenate((self.weights, [self.bias], self.transition.ravel()))
        first, second = np.zeros_like(params), np.zeros_like(params)
        for t in range(1, steps + 1):
            e, ahead, behind, total = self._forward_backward(x @ self.weights.astype(np.float32) + self.bias, mask)
            share = np.exp(ahead[..., 1] + behind[..., 1] - total[:, None, ])
            miss = np.where(mask, share - labels, 0)
            joint = np.exp(ahead[:, :-1, :, None] + self.transition + (e[:, 1:] + behind[:, 1:])[:, :, None, :]
                           - total[:, None, None, None])
            slope = np.concatenate((
                np.tensordot(miss, x, 2) / positions + l2 * self.weights, [miss.sum() / positions],
                (((joint * both).sum((0, 1)) - seen) / positions + l2 * self.transition).ravel()))
            first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
            params = params - rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
            self.weights, self.bias, self.transition = params[:-5], params[-5], params[-4:].reshape(2, 2)
        return self
