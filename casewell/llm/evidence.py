"""Evidence of a document as numbers: hashed words and character trigrams, and the shape of the text.

Words (ASCII letters folded) and trigrams of bytes are hashed into buckets and count once a text.
Their weights are fitted in two steps, on labelled rows only: how much more often a bucket
occurs in one class than in the other gives it a log ratio, and a ridge logistic regression on
presence times ratio, with the shape of the text beside it, gives it a weight. A text's
evidence is then one sum over its buckets.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .shingles import fold_bytes, mix64, word_hashes

BUCKET_BITS = 16  # for words, and again for trigrams
BUCKETS = 2 << BUCKET_BITS
SHAPE = ("capitals", "marks", "mark runs", "repeated words", "distinct words", "shortness")
RIDGE = 1e-3
SMOOTH = 1.0
TEXTS_AT_ONCE = 500
_MARK = np.array([33 <= b <= 47 or 58 <= b <= 64 or 91 <= b <= 96 or 123 <= b <= 126 for b in range(256)])


_dot = np.einsum  # small products, on one core


def features(at: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a run of texts: owner and bucket of each present bucket, and a row of ``SHAPE`` for each text.
    Shares of capitals and marks are of bytes, those of words of words; a text without words has
    zeros and a shortness of one."""
    words, n = word_hashes(at, raw)
    body, cuts, texts = raw[at[0] : at[-1]], at - at[0], len(at) - 1
    owner, byte_owner = np.repeat(np.arange(texts), n), np.repeat(np.arange(texts), np.diff(cuts))
    low = fold_bytes(body)
    grams = mix64((low[:-2] * np.uint64(0x10001) + low[1:-1]) * np.uint64(0x10001) + low[2:]) if len(body) > 2 else np.zeros(0, np.uint64)
    inside = byte_owner[:-2] == byte_owner[2:]
    shift, bits = np.uint64(64 - BUCKET_BITS), BUCKET_BITS + 1
    keys = [owner << bits | (words >> shift).astype(np.int64), byte_owner[:-2][inside] << bits | (grams[inside] >> shift).astype(np.int64) | 1 << BUCKET_BITS]
    present = np.unique(np.concatenate(keys))
    capital, mark = (body >= 65) & (body <= 90), _MARK[body]
    run = np.zeros(len(body), bool)
    run[1:] = mark[1:] & mark[:-1] & (byte_owner[1:] == byte_owner[:-1])
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    new = np.ones(len(words), bool)
    order = np.lexsort((words, owner))
    new[1:] = (words[order][1:] != words[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    of = lambda who, what: np.bincount(who, what, texts)
    length, count = np.maximum(np.diff(cuts), 1), np.maximum(n, 1)
    shape = [of(byte_owner, capital) / length, of(byte_owner, mark) / length, of(byte_owner, run) / length, of(owner, again) / count, of(owner, new) / count, 1 / count]
    return present >> bits, present & (BUCKETS - 1), np.column_stack(shape)


@dataclass(frozen=True)
class Evidence:
    """Log odds of a text: ``start + sum of weights of its buckets + shape @ slopes``."""

    start: float
    weights: np.ndarray
    slopes: np.ndarray

    def log_odds(self, owner: np.ndarray, bucket: np.ndarray, shape: np.ndarray) -> np.ndarray:
        return self.start + np.bincount(owner, self.weights[bucket], len(shape)) + _dot("ij,j->i", shape, self.slopes)


def fit(owner: np.ndarray, bucket: np.ndarray, shape: np.ndarray, y: np.ndarray, rounds: int = 60) -> Evidence:
    """``y`` (0 or 1, both present) for each text, ``owner`` in order; L-BFGS, from zeros, so the same rows
    give the same model. Sums are taken over blocks of texts, so that memory stays at the size of
    the sample."""
    n = len(y)
    cuts = np.searchsorted(owner, np.arange(0, n + TEXTS_AT_ONCE, TEXTS_AT_ONCE))
    blocks = [(slice(i * TEXTS_AT_ONCE, min((i + 1) * TEXTS_AT_ONCE, n)), slice(s, e)) for i, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if e > s]

    def per_bucket(of_text: np.ndarray) -> np.ndarray:
        out = np.zeros(BUCKETS)
        for _, part in blocks:
            out += np.bincount(bucket[part], of_text[owner[part]], BUCKETS)
        return out

    ones, noes = per_bucket(y), per_bucket(1 - y)
    ratio = np.log((ones + SMOOTH) / (y.sum() + 2 * SMOOTH)) - np.log((noes + SMOOTH) / ((1 - y).sum() + 2 * SMOOTH))
    ratio[ones + noes == 0] = 0
    middle, spread = shape.mean(0), shape.std(0) + 1e-9
    dense, k = (shape - middle) / spread, shape.shape[1]

    def parts(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        return w[:BUCKETS], w[BUCKETS : BUCKETS + k], w[-1]

    def value(w: np.ndarray) -> tuple[float, np.ndarray]:
        sparse, slopes, start = parts(w)
        z, weights = start + _dot("ij,j->i", dense, slopes), sparse * ratio
        for texts, part in blocks:
            z[texts] += np.bincount(owner[part] - texts.start, weights[bucket[part]], texts.stop - texts.start)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        off = (p - y) / n
        g = np.concatenate([per_bucket(off) * ratio, _dot("ij,i->j", dense, off), [off.sum()]])
        g[:-1] += RIDGE * w[:-1]
        return float(np.mean(np.logaddexp(0, z) - y * z) + RIDGE / 2 * _dot("i,i", w[:-1], w[:-1])), g

    w = np.zeros(BUCKETS + k + 1)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    loss, g = value(w)
    for _ in range(rounds):
        d, scales = g.copy(), []
        for s, t in reversed(moves):
            scales.append(_dot("i,i", s, d) / _dot("i,i", s, t))
            d -= scales[-1] * t
        if moves:
            d *= _dot("i,i", *moves[-1]) / _dot("i,i", moves[-1][1], moves[-1][1])
        for (s, t), a in zip(moves, reversed(scales), strict=True):
            d += s * (a - _dot("i,i", t, d) / _dot("i,i", s, t))
        step = 1.0 if moves else 1 / max(np.abs(g).sum(), 1e-12)
        while True:
            new = w - step * d
            new_loss, new_g = value(new)
            if new_loss <= loss - 1e-4 * step * _dot("i,i", g, d) or step < 1e-10:
                break
            step /= 2
        s, t = new - w, new_g - g
        done = loss - new_loss < 1e-7 * max(1.0, abs(loss))
        if _dot("i,i", s, t) > 1e-14:
            moves = [*moves, (s, t)][-8:]
        w, loss, g = new, new_loss, new_g
        if done:
            break
    sparse, slopes, start = parts(w)
    return Evidence(float(start - _dot("i,i", middle / spread, slopes)), (sparse * ratio).astype(np.float32), slopes / spread)
