"""A linear-chain conditional random field over sparse binary features, in numpy.

Scores of a word or line depend on its own features and on those of its two neighbours. Chains of
like length run side by side, so a step costs one array operation for a whole batch.
"""

from __future__ import annotations

import numpy as np


class Crf:
    """Emission weights for an item, the one before and the one after; transitions; start and end weights."""

    def __init__(self, features: int, labels: int):
        self.own = np.zeros((3, features, labels))
        self.move = np.zeros((labels, labels))
        self.ends = np.zeros((2, labels))

    def parameters(self) -> list[np.ndarray]:
        return [self.own, self.move, self.ends]

    def emissions(self, rows: np.ndarray) -> np.ndarray:
        """Label scores along one chain whose items have feature rows `rows`."""
        before = np.vstack([np.zeros((1, rows.shape[1])), rows[:-1]])
        after = np.vstack([rows[1:], np.zeros((1, rows.shape[1]))])
        return before @ self.own[0] + rows @ self.own[1] + after @ self.own[2]


def padded(chains: list[np.ndarray], width: int, dtype=float) -> tuple[np.ndarray, np.ndarray]:
    """Chains stacked to (chains, longest, width), and their lengths."""
    lengths = np.array([len(c) for c in chains])
    out = np.zeros((len(chains), max(lengths, default=0), width), dtype=dtype)
    for row, chain in zip(out, chains):
        row[:len(chain)] = chain
    return out, lengths


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def forward_backward(scores: np.ndarray, lengths: np.ndarray, move: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label marginals (chains x longest x labels, 0 past a chain's end), and the expected number of each step."""
    chains, longest, labels = scores.shape
    ahead, behind = np.zeros_like(scores), np.zeros_like(scores)
    ahead[:, 0] = ends[0] + scores[:, 0]
    for t in range(1, longest):
        ahead[:, t] = scores[:, t] + _logsumexp(ahead[:, t - 1, :, None] + move, 1)
    for t in range(longest - 1, -1, -1):
        last = (lengths == t + 1)[:, None]
        onward = _logsumexp(move + (scores[:, t + 1] + behind[:, t + 1])[:, None, :], 2) if t + 1 < longest else 0.0
        behind[:, t] = np.where(last, ends[1], onward)
    row = np.arange(chains)
    total = _logsumexp(ahead[row, lengths - 1] + ends[1], 1)
    steps = np.zeros_like(move)
    for t in range(1, longest):
        inside = lengths > t
        both = ahead[inside, t - 1, :, None] + move + (scores[inside, t] + behind[inside, t])[:, None, :]
        steps += np.exp(both - total[inside, None, None]).sum(axis=0)
    inside = np.arange(longest)[None, :] < lengths[:, None]
    marginals = np.zeros_like(scores)
    marginals[inside] = np.exp((ahead + behind - total[:, None, None])[inside])
    return marginals, steps


def train(data: list[tuple[np.ndarray, np.ndarray]], features: int, labels: int, rounds: int = 120,
          decay: float = 0.02, rate: float = 0.1) -> Crf:
    """Maximum likelihood with a quadratic penalty, by Adam, on (feature rows, labels) chains."""
    crf = Crf(features, labels)
    data = [(rows, gold) for rows, gold in data if len(gold)]
    if not data:
        return crf
    gold, lengths = padded([np.eye(labels)[g] for _, g in data], labels)
    inside = np.arange(gold.shape[1])[None, :] < lengths[:, None]
    rows = np.concatenate([r for r, _ in data])  # of all chains, one after the other
    starts = np.cumsum(lengths) - lengths
    before, after = np.zeros_like(rows), np.zeros_like(rows)
    before[1:], after[:-1] = rows[:-1], rows[1:]
    before[starts], after[starts + lengths - 1] = 0, 0
    flat = (before, rows, after)
    seen_steps = np.einsum("ctl,ctm->lm", gold[:, :-1], gold[:, 1:])
    row = np.arange(len(data))
    scores = np.zeros_like(gold)
    first = [np.zeros_like(p) for p in crf.parameters()]
    second = [np.zeros_like(p) for p in crf.parameters()]
    for step in range(1, rounds + 1):
        scores[inside] = sum(x @ w for x, w in zip(flat, crf.own))
        marginals, steps = forward_backward(scores, lengths, crf.move, crf.ends)
        error = marginals - gold
        slopes = [decay * p for p in crf.parameters()]
        slopes[0] += np.stack([x.T @ error[inside] for x in flat])
        slopes[1] += steps - seen_steps
        slopes[2] += np.stack([error[:, 0].sum(axis=0), error[row, lengths - 1].sum(axis=0)])
        for p, g, m, v in zip(crf.parameters(), slopes, first, second):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return crf


VITERBI_ITEMS = 100_000


def viterbi(chains: list[np.ndarray], move: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """The best label sequence of each chain of scores; chains of like length run side by side, about VITERBI_ITEMS items at a time."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(chains)
    order = sorted((i for i in range(len(chains)) if len(chains[i])), key=lambda i: len(chains[i]))
    while order:
        together = min(2048, max(1, VITERBI_ITEMS // len(chains[order[-1]])))
        order, some = order[:-together], order[-together:]
        lengths = np.array([len(chains[i]) for i in some])
        scores = np.zeros((len(some), lengths.max(), move.shape[0]))
        for row, i in enumerate(some):
            scores[row, :len(chains[i])] = chains[i]
        back = np.zeros(scores.shape, dtype=np.int8)
        best = ends[0] + scores[:, 0]
        last = best + ends[1]
        for t in range(1, scores.shape[1]):
            paths = best[:, :, None] + move
            back[:, t] = paths.argmax(axis=1)
            best = paths.max(axis=1) + scores[:, t]
            last = np.where((lengths == t + 1)[:, None], best + ends[1], last)
        label = last.argmax(axis=1)
        found = np.zeros(scores.shape[:2], dtype=np.int64)
        for t in range(scores.shape[1] - 1, -1, -1):
            inside = t < lengths
            found[inside, t] = label[inside]
            label = np.where(inside & (t > 0), back[np.arange(len(some)), t, label], label)
        for row, i in enumerate(some):
            out[i] = found[row, :lengths[row]]
    return out
