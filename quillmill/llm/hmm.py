"""A hidden Markov model over word classes in numpy: expected counts, their maximisation, exact likelihoods.

Everything works on many sequences at once, a step at a time. Probabilities are rescaled at every step, so sequences
of any length neither overflow nor vanish; the logarithms of the scales sum to the sequence's likelihood.

For expected counts sequences are cut to segments, so that long ones need no more steps than short ones. Nothing is lost
at the cuts: the product of a segment's transition matrices carries the state before it to its end, and what follows it
back to its start, so each segment has the forward and backward vectors of its whole sequence.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Hmm:
    """start (1, states); move (states, states); emit (states, classes)."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    @staticmethod
    def fresh(class_counts: np.ndarray, states: int, seed: int = 3, noise: float = 0.5, stay: float = 0.9) -> Hmm:
        """Near the classes' own frequencies, each state shifted at random, and inclined to stay."""
        rng = np.random.default_rng(seed)
        share = (class_counts + 1.0) / (class_counts + 1.0).sum()
        emit = share * np.exp(rng.normal(0, noise, (states, len(share))))
        move = np.full((states, states), (1 - stay) / max(states - 1, 1))
        np.fill_diagonal(move, stay if states > 1 else 1.0)
        return Hmm(np.full((1, states), 1 / states), move, emit / emit.sum(axis=1, keepdims=True))

    @property
    def parameters(self) -> int:
        return self.start.size + self.move.size + self.emit.size

    def maximised(self, counts: np.ndarray) -> Hmm:
        """The model that expected counts (flat, in the order of the parameters) make likeliest, smoothed a little."""
        a, b = self.start.size, self.start.size + self.move.size

        def rows(part: np.ndarray, shape: tuple, add: float) -> np.ndarray:
            part = part.reshape(shape) + add
            return part / part.sum(axis=1, keepdims=True)

        return Hmm(
            rows(counts[:a], self.start.shape, 0.01), rows(counts[a:b], self.move.shape, 0.01), rows(counts[b:], self.emit.shape, 0.01)
        )


def _unit(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=-1, keepdims=True)


@dataclass(frozen=True)
class Segments:
    """Parts of sequences, longest first: where each starts in ``flat`` and its steps; ``before`` is the row of the part
    that it goes on from, or -1. Only a sequence's last part has fewer steps than the others."""

    flat: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    before: np.ndarray

    def at(self, rows: np.ndarray | slice, t: int) -> np.ndarray:
        return self.flat[self.starts[rows] + t]


def _carried(model: Hmm, emit: np.ndarray, move: np.ndarray, held: Segments) -> tuple[np.ndarray, np.ndarray]:
    """For each part the state at the end of the one before it (if any), and the weights of what comes after it."""
    n, states, before = len(held.starts), len(move), held.before
    entering, leaving = np.ones((n, states), np.float32), np.ones((n, states), np.float32)
    later = np.flatnonzero(before >= 0)
    if not len(later):
        return entering, leaving
    steps = int(held.lengths[0])
    product = np.broadcast_to(np.eye(states, dtype=np.float32), (len(later), states, states)).copy()
    alive = np.searchsorted(-held.lengths[later], -np.arange(steps), side="left")
    for t in range(int(held.lengths[later[0]])):
        k = alive[t]
        product[:k] = (product[:k].reshape(-1, states) @ move).reshape(k, states, states) * emit[held.at(later[:k], t)][:, None, :]
        if t % 8 == 7:
            product[:k] /= product[:k].max(axis=(1, 2), keepdims=True)
    product /= product.max(axis=(1, 2), keepdims=True)
    place = np.full(n, -1)
    place[later] = np.arange(len(later))
    opening = np.unique(before[later][before[before[later]] < 0])  # first parts that others follow
    ends = np.ones((n, states), np.float32)
    now = _unit(model.start.astype(np.float32) * emit[held.at(opening, 0)])
    for t in range(1, steps):
        now = _unit((now @ move) * emit[held.at(opening, t)])
    ends[opening] = now
    after = np.full(n, -1)
    after[before[later]] = later
    waves, wave = [], after[opening]
    while len(wave := wave[wave >= 0]):
        waves.append(wave)
        entering[wave] = ends[before[wave]]
        ends[wave] = _unit(np.einsum("ks,kst->kt", entering[wave], product[place[wave]]))
        wave = after[wave]
    for wave in reversed(waves):
        leaving[before[wave]] = _unit(np.einsum("kst,kt->ks", product[place[wave]], leaving[wave]))
    return entering, leaving


def expected_counts(model: Hmm, held: Segments) -> tuple[np.ndarray, float]:
    """Baum-Welch counts of whole sequences, flat in the order of the parameters, and the log-likelihood."""
    emit = np.ascontiguousarray(model.emit.T).astype(np.float32)
    move = model.move.astype(np.float32)
    states, steps = move.shape[0], int(held.lengths[0])
    alive = np.searchsorted(-held.lengths, -np.arange(steps), side="left")
    entering, leaving = _carried(model, emit, move, held)
    opens = held.before < 0
    forward, scales = [], []
    now = np.where(opens[:, None], model.start.astype(np.float32), entering @ move) * emit[held.at(slice(None), 0)]
    for t in range(steps):
        if t:
            n = alive[t]
            now = (now[:n] @ move) * emit[held.at(slice(n), t)]
        scale = now.sum(axis=1, keepdims=True)
        now = now / scale
        forward.append(now)
        scales.append(scale)
    moved = np.zeros((states, states))
    emitted = np.zeros(emit.shape[0] * states)
    of_state = np.arange(states)
    backward, waiting = np.zeros((0, states), np.float32), []
    for t in range(steps - 1, -1, -1):
        n = alive[t]
        if len(backward) < n:  # parts that end here
            ending = leaving[len(backward) : n]
            ending = ending / (forward[t][len(backward) : n] * ending).sum(axis=1, keepdims=True)
            backward = np.concatenate([backward, ending])
        posterior = forward[t] * backward
        classes = held.at(slice(n), t)
        waiting.append((classes, posterior))
        if t == 0 or sum(len(c) for c, _ in waiting) > 50_000:
            place = np.concatenate([c for c, _ in waiting])[:, None] * states + of_state
            emitted += np.bincount(place.ravel(), weights=np.concatenate([p for _, p in waiting]).ravel(), minlength=len(emitted))
            waiting = []
        ahead = emit[classes] * backward / scales[t]
        if t:
            moved += (forward[t - 1][:n].T @ ahead) * move
            backward = ahead @ move.T
        else:
            moved += (entering[~opens].T @ ahead[~opens]) * move
            started = posterior[opens].sum(axis=0)
    likelihood = float(sum(np.log(s, dtype=np.float64).sum() for s in scales))
    return np.concatenate([started, moved.ravel(), emitted.reshape(-1, states).T.ravel()]), likelihood


def log10_likelihoods(model: Hmm, sequences: list[np.ndarray]) -> np.ndarray:
    """The log10 probability of each whole sequence of classes (each of at least one step)."""
    lengths = np.array([len(s) for s in sequences])
    order = np.argsort(-lengths, kind="stable")
    starts = np.cumsum(np.r_[0, lengths[order]])[:-1]
    flat = np.concatenate([sequences[i] for i in order])
    emit = np.ascontiguousarray(model.emit.T)
    ranked = lengths[order]
    steps = int(ranked[0])
    alive = np.searchsorted(-ranked, -np.arange(steps), side="left")
    now = model.start[0] * emit[flat[starts]]
    total = np.zeros(len(sequences))
    for t in range(steps):
        n = alive[t]
        if t:
            now = (now[:n] @ model.move) * emit[flat[starts[:n] + t]]
        scale = now.sum(axis=1)
        now = now / scale[:, None]
        total[:n] += np.log10(scale)
    out = np.empty(len(sequences))
    out[order] = total
    return out


def segments_of(sequences: list[np.ndarray], steps: int) -> tuple[Segments]:
    """Sequences cut to parts of at most ``steps`` classes."""
    sizes = np.array([len(s) for s in sequences])
    pieces = -(-sizes // steps)
    first = np.cumsum(pieces) - pieces
    rank = np.arange(int(pieces.sum())) - np.repeat(first, pieces)
    lengths = np.minimum(np.repeat(sizes, pieces) - rank * steps, steps)
    starts = np.repeat(np.cumsum(sizes) - sizes, pieces) + rank * steps
    order = np.argsort(-lengths, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    before = np.where(rank > 0, place[np.maximum(np.arange(len(rank)) - 1, 0)], -1)[order]
    return (Segments(np.concatenate(sequences), starts[order], lengths[order], before),)
