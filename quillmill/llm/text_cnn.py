"""A convolutional text classifier in numpy: hashed word embeddings, filters of several widths, max pooling.

A word's vector is the sum of hashed embeddings of the word and of its first letters, so that an unseen form of a
known stem has a meaning. Filters of widths 1 to 3 slide over the whole text; each filter's largest response is the
text's feature, and a linear layer makes the logit. As a filter's response is a sum over its positions, a word's
share of it is computed once for each distinct word: the rest is a gather, an add and a maximum by blocks of windows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, cached_property

import numpy as np

NO_WORD = re.compile(r"\W")
PREFIXES = (4, 5)
WIDTHS = (1, 2, 3)
GAP = max(WIDTHS) - 1
STRETCH = 60_000
PLACES = 16_384
BLOCK = 16
PIECE = 1 << 16
BITS = 20
BASE = 0x9E3779B97F4A7C15


def _hash_powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the hash's base from 0 on, and their inverses, modulo 2 ** 64."""
    powers = np.full((2, size), [[BASE], [pow(BASE, -1, 1 << 64)]], np.uint64)
    powers[:, 0] = 1
    return tuple(np.multiply.accumulate(powers, axis=1))


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which code points are a word's, as \\w has it, and the powers that a piece needs."""
    inside = np.fromiter(map(str.isalnum, map(chr, range(0x110000))), bool, 0x110000)
    inside[ord("_")] = True
    return inside, *_hash_powers(2 * PIECE + 1)


def _pieces(text: str) -> Iterator[tuple[str, bool]]:
    """A text in pieces of 2 * PIECE code points at most, and whether a piece goes on with the word that the last one ended in."""
    low, within = 0, False
    while True:
        end = len(text)
        cut = None
        if end - low > 2 * PIECE:
            end = low + 2 * PIECE
            if cut := NO_WORD.search(text, low + PIECE, end):
                end = cut.start()
        yield text[low:end], within
        if end == len(text):
            return
        low, within = end, cut is None


def _mixed(values: np.ndarray) -> np.ndarray:
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        values = (values ^ values >> np.uint64(33)) * np.uint64(factor)
    return values ^ values >> np.uint64(33)


def _packed(hashes: list[np.ndarray], lengths: np.ndarray, buckets: int) -> np.ndarray:
    """A word's features, its own and those of its prefixes, in 64 bits: each hash's bucket, or ``buckets`` if it has no such prefix."""
    out = np.zeros(len(lengths), np.int64)
    for k, (found, n) in enumerate(zip(hashes, (0, *PREFIXES), strict=True)):
        bucket = (_mixed(found + np.uint64(k)) % np.uint64(buckets)).astype(np.int64)
        out |= np.where(lengths >= n, bucket, buckets) << BITS * k
    return out


def packed_words(texts: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """How many words each text has, and the features of all words, lower-cased, one after another (see _packed).

    Words are hashed from sums over code points, a piece at a time, so that no word is ever an object.
    """
    counts = np.zeros(len(texts), np.int64)
    out: list[np.ndarray] = []
    last: list = []  # hashes and length of the last word
    held: list[tuple[int, str]] = []
    inside_of, powers, inverse = _tables()

    def look(goes_on: bool) -> None:
        sizes = np.array([len(t) + 1 for _, t in held])
        codes = np.frombuffer("\n".join(t for _, t in held).encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = np.zeros(len(codes) + 2, bool)
        inside_of.take(codes, out=inside[1:-1])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * powers[: len(codes)], out=sums[1:])
        before, shift, lengths = sums[starts], inverse[starts], ends - starts
        hashes = [(sums[ends] - before) * shift, *((sums[np.minimum(starts + n, ends)] - before) * shift for n in PREFIXES)]
        found = np.diff(np.searchsorted(starts, np.r_[0, np.cumsum(sizes)]))
        if goes_on and len(starts) and not starts[0]:  # the last word has more than its prefixes
            hashes[0][0] = (int(hashes[0][0]) * pow(BASE, last[1], 1 << 64) + last[0][0]) % (1 << 64)
            for k in range(len(PREFIXES)):
                hashes[k + 1][0] = last[0][k + 1]
            lengths[0] += last[1]
            out[-1] = out[-1][:-1]
            found[0] -= 1
        np.add.at(counts, [k for k, _ in held], found)
        if len(starts):
            last[:] = [int(h[-1]) for h in hashes], int(lengths[-1])
            out.append(_packed(hashes, lengths, buckets))
        held.clear()

    size = 0
    for k, text in enumerate(texts):
        for piece, goes_on in _pieces(text.lower()):
            if held and (goes_on or size + len(piece) + 1 > PIECE):
                look(False)
                size = 0
            held.append((k, piece))
            size += len(piece) + 1
            if goes_on:
                look(True)
                size = 0
    if held:
        look(False)
    return counts, np.concatenate(out) if out else np.zeros(0, np.int64)


def unpacked(packed: np.ndarray) -> np.ndarray:
    """The features of words, a row each."""
    return np.stack([packed >> BITS * j & (1 << BITS) - 1 for j in range(1 + len(PREFIXES))], axis=1).astype(np.int32)


@dataclass
class TextCnn:
    """Parameters: embedding (buckets + 1, dim; the last row stays zero), filters[width] (width, dim, filters)."""

    embedding: np.ndarray
    filters: dict[int, np.ndarray]
    bias: dict[int, np.ndarray]
    out: np.ndarray
    out_bias: float

    @property
    def buckets(self) -> int:
        return len(self.embedding) - 1

    @staticmethod
    def fresh(buckets: int = 1 << 15, dim: int = 16, filters: int = 8, seed: int = 0) -> TextCnn:
        rng = np.random.default_rng(seed)
        embedding = rng.normal(0, 0.1, (buckets + 1, dim)).astype(np.float32)
        embedding[-1] = 0
        convolution = {w: rng.normal(0, 0.5 / np.sqrt(w), (w, dim, filters)).astype(np.float32) for w in WIDTHS}
        bias = {w: np.zeros(filters, np.float32) for w in WIDTHS}
        out = rng.normal(0, 0.3, filters * len(WIDTHS)).astype(np.float32)
        return TextCnn(embedding, convolution, bias, out, 0.0)

    @staticmethod
    def average(models: list[TextCnn]) -> TextCnn:
        """One network whose logit is the mean of the models' logits."""
        n, dim, f = len(models), models[0].embedding.shape[1], len(models[0].bias[1])
        filters = {}
        for w in WIDTHS:
            filters[w] = np.zeros((w, dim * n, f * n), np.float32)
            for k, m in enumerate(models):
                filters[w][:, k * dim : (k + 1) * dim, k * f : (k + 1) * f] = m.filters[w]
        bias = {w: np.concatenate([m.bias[w] for m in models]) for w in WIDTHS}
        out = np.concatenate([m.out[j * f : (j + 1) * f] / n for j in range(len(WIDTHS)) for m in models])
        embedding = np.concatenate([m.embedding for m in models], axis=1)
        return TextCnn(embedding, filters, bias, out, float(np.mean([m.out_bias for m in models])))

    def vectors(self, features: np.ndarray) -> np.ndarray:
        out = self.embedding.take(features[:, 0], axis=0)
        for k in range(1, features.shape[1]):
            out += self.embedding.take(features[:, k], axis=0)
        return out

    def copy(self) -> TextCnn:
        filters, bias = ({w: v.copy() for w, v in held.items()} for held in (self.filters, self.bias))
        return TextCnn(self.embedding.copy(), filters, bias, self.out.copy(), self.out_bias)

    def dense(self) -> np.ndarray:
        """All parameters but the embedding, one after another."""
        return np.concatenate([*(self.filters[w].ravel() for w in WIDTHS), *(self.bias[w] for w in WIDTHS), self.out, [self.out_bias]])

    def set_dense(self, values: np.ndarray) -> None:
        at = 0
        for held in (*(self.filters[w] for w in WIDTHS), *(self.bias[w] for w in WIDTHS), self.out):
            held[...] = values[at : at + held.size].reshape(held.shape)
            at += held.size
        self.out_bias = float(values[at])


@dataclass(frozen=True)
class Texts:
    """Texts as numbers of words, one after another: ``vocabulary`` holds each word's features, packed."""

    vocabulary: np.ndarray
    codes: np.ndarray
    lengths: np.ndarray

    @cached_property
    def ends(self) -> np.ndarray:
        return np.cumsum(self.lengths)

    @cached_property
    def number(self) -> np.ndarray:
        return np.zeros(len(self.vocabulary) + 2, np.int32)

    def laid_out(self, chosen: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Some texts one after another: (features of their words, which one each is, starts, lengths).

        An empty text has the last word but one, which is empty; the last word fills what is between texts, at least GAP
        places, so that each text starts at a multiple of BLOCK.
        """
        empty = len(self.vocabulary)
        lengths = np.maximum(self.lengths[chosen], 1)
        room = -(-(lengths + GAP) // BLOCK) * BLOCK
        starts = np.cumsum(room) - room
        codes = np.full(int(room.sum()) + GAP, empty + 1, np.int32)
        for i, at in zip(chosen.tolist(), starts.tolist(), strict=True):
            n, end = int(self.lengths[i]), int(self.ends[i])
            codes[at : at + max(n, 1)] = self.codes[end - n : end] if n else empty
        held = np.zeros(empty + 2, bool)
        held[codes] = True
        held[empty] = True
        some = np.flatnonzero(held)
        self.number[some] = np.arange(len(some), dtype=np.int32)
        features = np.full((len(some), 1 + len(PREFIXES)), buckets, np.int32)
        features[:-2] = unpacked(self.vocabulary[some[:-2]])
        return features, self.number[codes], starts, lengths


def peaks(
    model: TextCnn, vectors: np.ndarray, words: np.ndarray, starts: np.ndarray, lengths: np.ndarray, stretch: int = PLACES, places: bool = True, void: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Largest response of each filter in each text, and, if asked for, the place in ``words`` where its first such window starts.

    ``vectors`` has a row for each word of texts as Texts lays them out. No window starts at a place in ``void``. The words
    are looked at in stretches, so that memory is bounded for any text.
    """
    f = len(model.bias[1])
    columns = [vectors @ model.filters[w][k] for w in WIDTHS for k in range(w)]
    best = np.full((len(starts), f * len(WIDTHS)), -np.inf, np.float32)
    where = np.zeros(best.shape, np.int64)
    words = words.astype(np.intp)
    total, every = len(words) - GAP, np.arange(f)
    from_block, to_block = starts // BLOCK, -(-(starts + lengths) // BLOCK)
    stretch = max(1, stretch // BLOCK)  # in blocks
    for low in range(0, total // BLOCK, stretch):
        high = min(low + stretch, total // BLOCK)
        inside = np.flatnonzero((from_block < high) & (to_block > low))
        if not len(inside):
            continue
        first = np.maximum(from_block[inside], low) - low
        own = np.diff(np.r_[first, high - low])
        number = np.arange(high - low)[:, None]
        column = 0
        for j, w in enumerate(WIDTHS):
            place = slice(low * BLOCK, high * BLOCK)
            columns[column][-1] = -np.inf  # no window starts between texts
            response = columns[column].take(words[place], axis=0, mode="clip")
            for k in range(1, w):
                response += columns[column + k].take(words[place.start + k : place.stop + k], axis=0, mode="clip")
            column += w
            if void is not None:
                response[void[(void >= place.start) & (void < place.stop)] - place.start] = -np.inf
            response = response.reshape(high - low, BLOCK, f)
            top, n = response, BLOCK
            while n > 1:
                n //= 2
                top = np.maximum(top[:, :n], top[:, n:])
            by_block = top.reshape(high - low, f)
            top = np.maximum.reduceat(by_block, first, axis=0)
            mine = inside[:, None], (j * f + every)[None, :]
            better = top > best[mine]
            if places:
                lead = first[0]
                hit = np.where(by_block[lead:] == np.repeat(top, own, axis=0), number[lead:], high - low)
                block = np.minimum.reduceat(hit, first - lead, axis=0)
                at = response[block, :, every[None, :]].argmax(axis=2) + (block + low) * BLOCK
                where[mine] = np.where(better, at, where[mine])
            best[mine] = np.where(better, top, best[mine])
    return np.maximum(best + np.concatenate([model.bias[w] for w in WIDTHS]), 0), where


def batches_of(lengths: np.ndarray, order: np.ndarray, rows: int = 64, words: int = STRETCH) -> Iterator[np.ndarray]:
    """``order`` in parts of at most ``rows`` texts, and of ``words`` words or one text."""
    low, held = 0, 0
    for k, i in enumerate(order):
        if k > low and (k - low == rows or held + lengths[i] > words):
            yield order[low:k]
            low, held = k, 0
        held += lengths[i]
    if low < len(order):
        yield order[low:]


class _Adam:
    def __init__(self, rate: float):
        self.rate, self.step, self.state = rate, 0, {}

    def update(self, name: str, value: np.ndarray, gradient: np.ndarray, rows: np.ndarray | None = None) -> None:
        if name not in self.state:
            self.state[name] = np.zeros_like(value), np.zeros_like(value)
        m, v = self.state[name]
        at = slice(None) if rows is None else rows
        old_m, old_v = (m, v) if rows is None else (m.take(rows, axis=0), v.take(rows, axis=0))
        new_m, new_v = old_m * 0.9 + 0.1 * gradient, old_v * 0.999 + 0.001 * gradient**2
        m[at], v[at] = new_m, new_v
        value[at] -= self.rate * (new_m / (1 - 0.9**self.step)) / (np.sqrt(new_v / (1 - 0.999**self.step)) + 1e-8)


def _summed(ids: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids, in order, and the sum of the rows of each."""
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    return ids[first], np.add.reduceat(values.take(order, axis=0), first, axis=0)


def train(
    model: TextCnn, texts: Texts, labels: np.ndarray, toxic_weight: float, passes: int = 8, batch: int = 64, rate: float = 0.02, seed: int = 0
) -> tuple[TextCnn, np.ndarray]:
    """``model`` fitted further on ``texts``, and the rows of its embedding that were moved. The order is fixed by seed."""
    model = model.copy()
    adam, rng = _Adam(rate), np.random.default_rng(seed)
    weight = np.where(labels > 0, toxic_weight, 1.0)
    f, lengths_of = len(model.bias[1]), texts.lengths
    moved = np.zeros(len(model.embedding), bool)
    for _ in range(passes):
        for chosen in batches_of(lengths_of, rng.permutation(len(labels)), batch):
            features, words, starts, lengths = texts.laid_out(chosen, model.buckets)
            vectors = model.vectors(features)
            hidden, where = peaks(model, vectors, words, starts, lengths)
            probability = 1 / (1 + np.exp(-np.clip(hidden @ model.out + model.out_bias, -30, 30)))
            slope = ((probability - labels[chosen]) * weight[chosen] / weight[chosen].sum()).astype(np.float32)
            adam.step += 1
            back = slope[:, None] * model.out[None, :] * (hidden > 0)
            touched, moves, gradients = [], [], {}
            for j, w in enumerate(WIDTHS):
                g, at = back[:, j * f : (j + 1) * f], where[:, j * f : (j + 1) * f]
                document, column = np.nonzero(g)
                value = g[document, column][:, None]
                change = np.zeros_like(model.filters[w])
                for k in range(w):
                    ids = words[at + k]
                    change[k] = np.einsum("dfe,df->ef", vectors[ids], g)
                    touched.append(ids[document, column])
                    moves.append(model.filters[w][k].T[column] * value)
                gradients[w] = change, g.sum(axis=0)
            out_gradient = hidden.T @ slope
            for w, (change, shift) in gradients.items():
                adam.update(f"filter{w}", model.filters[w], change)
                adam.update(f"bias{w}", model.bias[w], shift)
            adam.update("out", model.out, out_gradient)
            model.out_bias -= rate * float(slope.sum())
            ids = np.concatenate(touched)
            if len(ids):
                ids, gradient = _summed(ids, np.concatenate(moves))  # by word, then by feature
                ids, gradient = _summed(features[ids].T.ravel(), np.tile(gradient, (features.shape[1], 1)))
                adam.update("embedding", model.embedding, gradient, ids)
                model.embedding[-1] = 0
                moved[ids] = True
    return model, moved
