"""A linear-chain conditional random field over categorical features, in numpy.

An item has one value in each of several feature slots; its score for a label is the sum of the
slots' weights. Training maximises the penalised log-likelihood of whole label sequences (forward and
backward sums, Adam); decoding finds the best label sequence (Viterbi), many sequences in lockstep.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class ChainCRF:
    offsets: np.ndarray   # where each slot's values begin in ``weights``
    weights: np.ndarray   # values x labels
    steps: np.ndarray     # from label x to label
    first: np.ndarray     # score of a label at the beginning
    last: np.ndarray      # and at the end

    def scores(self, features: np.ndarray) -> np.ndarray:
        """Label scores of items; ``features`` has a row for each item."""
        out = self.weights[features[:, 0] + self.offsets[0]]
        for s in range(1, features.shape[1]):
            out = out + self.weights[features[:, s] + self.offsets[s]]
        return out

    def decode(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best labels of consecutive sequences with ``lengths`` items (none may be empty)."""
        labels = np.zeros(len(scores), np.int64)
        if not len(lengths):
            return labels
        begin = np.cumsum(lengths) - lengths
        order = np.argsort(-lengths, kind="stable")
        begin, lengths = begin[order], lengths[order]
        running = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")  # longer than j
        best = scores[begin] + self.first
        back = np.zeros((len(scores), scores.shape[1]), np.int8)
        for j in range(1, int(lengths[0])):
            n = running[j]
            paths = best[:n, :, None] + self.steps
            back[begin[:n] + j] = paths.argmax(axis=1)
            best[:n] = paths.max(axis=1) + scores[begin[:n] + j]
        now = (best + self.last).argmax(axis=1)
        labels[begin + lengths - 1] = now
        for j in range(int(lengths[0]) - 1, 0, -1):
            n = running[j]
            now[:n] = back[begin[:n] + j, now[:n]]
            labels[begin[:n] + j - 1] = now[:n]
        return labels

    def settled(self, scores: np.ndarray, label: int) -> np.ndarray:
        """Items at which some best sequence surely has ``label``, whatever their neighbours have: the
        lead of its score is at least all that another label can gain in the steps before and after. The
        sequences may be cut there without changing what Viterbi decoding finds."""
        before = np.vstack((self.steps, self.first))   # rows: previous label, or none
        after = np.hstack((self.steps, self.last[:, None]))
        out = np.ones(len(scores), bool)
        for y in range(scores.shape[1]):
            if y != label:
                gain = ((before[:, y] - before[:, label]).max() + (after[y] - after[label]).max())
                out &= scores[:, label] - scores[:, y] >= gain
        return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def fit(sequences: list[tuple[np.ndarray, np.ndarray]], cards: list[int], labels: int,
        rounds: int = 80, rate: float = 0.2, penalty: float = 1.0) -> ChainCRF:
    """Fit to (features, labels) pairs; slot s has values 0 to ``cards[s]`` - 1. Deterministic."""
    sequences = sorted((s for s in sequences if len(s[1])), key=lambda s: -len(s[1]))
    lengths = np.array([len(y) for _, y in sequences])
    n, longest = len(sequences), int(lengths[0])
    offsets = np.concatenate(([0], np.cumsum(cards)[:-1]))
    values = int(sum(cards))
    place = np.zeros((n, longest), bool)
    for i, k in enumerate(lengths):
        place[i, :k] = True
    rows, cols = np.nonzero(place)
    features = np.concatenate([x for x, _ in sequences]) + offsets
    gold = np.zeros((n, longest), np.int64)
    gold[rows, cols] = np.concatenate([y for _, y in sequences])
    running = (lengths[:, None] > np.arange(longest)).sum(axis=0)
    eye = np.eye(labels)
    pairs = np.zeros((labels, labels))
    for j in range(1, longest):
        m = running[j]
        np.add.at(pairs, (gold[:m, j - 1], gold[:m, j]), 1)
    ends = gold[np.arange(n), lengths - 1]
    model = ChainCRF(offsets, np.zeros((values, labels)), np.zeros((labels, labels)), np.zeros(labels), np.zeros(labels))
    params = [model.weights, model.steps, model.first, model.last]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    flat = features.ravel()
    for t in range(1, rounds + 1):
        score = np.zeros((n, longest, labels))
        score[rows, cols] = model.weights[features].sum(axis=1)
        ahead = np.zeros_like(score)
        ahead[:, 0] = score[:, 0] + model.first
        for j in range(1, longest):
            m = running[j]
            ahead[:m, j] = score[:m, j] + _log_sum(ahead[:m, j - 1, :, None] + model.steps, 1)
        behind = np.zeros_like(score)
        behind[np.arange(n), lengths - 1] = model.last
        total_pairs = np.zeros_like(pairs)
        norm = _log_sum(ahead[np.arange(n), lengths - 1] + model.last, 1)
        for j in range(longest - 1, 0, -1):
            m = running[j]
            right = score[:m, j] + behind[:m, j]
            joint = ahead[:m, j - 1, :, None] + model.steps + right[:, None, :]
            total_pairs += np.exp(joint - norm[:m, None, None]).sum(axis=0)
            behind[:m, j - 1] = _log_sum(model.steps + right[:, None, :], 2)
        p = np.exp(ahead + behind - norm[:, None, None])[rows, cols]
        miss = eye[gold[rows, cols]] - p
        grad = np.stack([np.bincount(flat, np.repeat(miss[:, y], features.shape[1]), values)
                         for y in range(labels)], axis=1)
        full = np.zeros((n, longest, labels))
        full[rows, cols] = p
        grads = [grad, pairs - total_pairs, eye[gold[:, 0]].sum(axis=0) - full[:, 0].sum(axis=0),
                 eye[ends].sum(axis=0) - full[np.arange(n), lengths - 1].sum(axis=0)]
        for q, g, (m1, m2) in zip(params, grads, moments, strict=True):
            g = g - penalty * q
            m1 += 0.1 * (g - m1)
            m2 += 0.001 * (g * g - m2)
            q += rate * (m1 / (1 - 0.9 ** t)) / (np.sqrt(m2 / (1 - 0.999 ** t)) + 1e-8)
    return model
