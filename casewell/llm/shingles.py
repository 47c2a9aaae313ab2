"""Word shingles of Arrow text batches, hashed with NumPy on the UTF-8 buffers.

Words are runs of bytes that are not ASCII white space, ASCII letters folded to lower case. A
shingle is five words in a row; a text of one to four words has one shingle of all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORDS = 5
CHUNK_BYTES = 1 << 20
HASH_BITS = 48  # of a shingle; the other 16 bits number the document while sorting
_BASE, _BACK = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[65:91] += np.uint64(32)
_FOLD += np.uint64(1)
_STEP = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
_powers: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fold_bytes(body: np.ndarray) -> np.ndarray:
    """Bytes as positive numbers, ASCII letters in lower case."""
    return _FOLD[body]


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    if len(_powers.get(name, ())) < n:
        x = np.full(max(n, CHUNK_BYTES), base, np.uint64)
        x[0] = 1
        _powers[name] = np.multiply.accumulate(x)
    return _powers[name][:n]


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    _, offsets, data = texts.buffers()
    kind = np.dtype(np.int64 if pa.types.is_large_string(texts.type) else np.int32)
    at = np.frombuffer(offsets, kind, len(texts) + 1, texts.offset * kind.itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return at, raw


def word_hashes(at: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and the number of words of each text."""
    body = raw[at[0] : at[-1]]
    at = at - at[0]
    gap = np.ones(len(body) + 1, bool)
    gap[:-1] = _SPACE[body]
    first = np.zeros(len(body) + 1, bool)
    first[at] = True
    inside = ~gap[:-1]
    before = np.ones(len(body), bool)
    before[1:] = gap[:-2]
    starts = np.flatnonzero(inside & (before | first[:-1]))
    ends = np.flatnonzero(inside & (gap[1:] | first[1:])) + 1
    total = np.zeros(len(body) + 1, np.uint64)
    np.cumsum(_FOLD[body] * _power("up", _BASE, len(body)), out=total[1:])
    hashes = mix64((total[ends] - total[starts]) * _power("down", _BACK, len(body))[starts])
    return hashes, np.diff(np.searchsorted(starts, at))


def shingles(at: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, their counts, and the texts' bounds in both."""
    words, n = word_hashes(at, raw)
    bounds = np.concatenate([[0], np.cumsum(n)])
    doc = np.repeat(np.arange(len(n)), n)
    if len(words) >= WORDS:
        whole = len(words) - WORDS + 1
        h = np.zeros(whole, np.uint64)
        for j in range(WORDS):
            h += words[j : j + whole] * _STEP[j]
        here = doc[:whole] == doc[WORDS - 1 :]
        h, owner = mix64(h[here]), doc[:whole][here]
    else:
        h, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((n > 0) & (n < WORDS))
    if len(short):
        h2 = np.zeros(len(short), np.uint64)
        for j in range(WORDS - 1):
            has = n[short] > j
            h2[has] += words[bounds[short[has]] + j] * _STEP[j]
        h, owner = np.concatenate([h, mix64(h2)]), np.concatenate([owner, short])
    keys = np.sort((owner.astype(np.uint64) << np.uint64(HASH_BITS)) | (h >> np.uint64(64 - HASH_BITS)))
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    at_new = np.flatnonzero(new)
    keys, counts = keys[at_new], np.diff(np.append(at_new, len(keys)))
    cuts = np.searchsorted(keys >> np.uint64(HASH_BITS), np.arange(len(n) + 1, dtype=np.uint64))
    return keys & np.uint64((1 << HASH_BITS) - 1), counts, cuts


def chunks(texts: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts of about ``size`` bytes (a longer text is a run of its own): first, end,
    offsets and bytes. Null texts are empty."""
    if len(texts) == 0:
        return
    at, raw = _buffers(texts)
    i = 0
    while i < len(texts):
        j = int(np.searchsorted(at, at[i] + size, "right")) - 1
        j = min(max(j, i + 1), i + 60_000, len(texts))
        yield i, j, at[i : j + 1], raw
        i = j
