"""Words and shingles of whole batches of UTF-8 texts, cut and hashed in numpy without a Python step per word."""

from __future__ import annotations

import numpy as np

P, Q = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: Bytes of text that callers should take at a time; a longer text is taken whole.
CHUNK = 1 << 20

#: A byte's value in a word, 0 where it separates words: white space does, A-Z is lower-cased.
SPACED = np.arange(256, dtype=np.uint8)
SPACED[65:91] += 32
SPACED[[9, 10, 11, 12, 13, 32]] = 0

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> list[np.ndarray]:
    """P**i and P**-i, modulo 2**64, for i below n at least."""
    if len(_powers[0]) < n:
        for k, p in enumerate((P, pow(P, -1, 1 << 64))):
            out = np.full(max(n, CHUNK + 1), p, np.uint64)
            out[0] = 1
            _powers[k] = np.multiply.accumulate(out)
    return _powers


def word_hashes(texts: list[bytes], form: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, its start, its stop, the first word of each text and the end), places being those in the
    texts joined by a line feed. A hash is a polynomial in the word's bytes modulo 2**64, from prefix sums, then mixed."""
    raw = b"\n".join(texts)
    low = form[np.frombuffer(raw, np.uint8)]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (low != 0).view(np.int8), [0]])))
    starts, stops = edge[::2], edge[1::2]
    up, down = _powers_to(len(low))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(low * up[: len(low)], dtype=np.uint64)])
    h = (total[stops] - total[starts]) * down[starts]
    h ^= h >> np.uint64(29)
    h *= np.uint64(Q)
    first = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))
    return h, starts, stops, first


#: Words of a shingle.
SHINGLE = 5


def shingles_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of all texts, and how many each text has. A zero byte of a text counts as white space."""
    words, _, _, first = word_hashes(texts)
    n = np.diff(first)
    counts = np.where(n >= SHINGLE, n - SHINGLE + 1, (n > 0).astype(np.int64))
    padded = np.concatenate([words, np.zeros(SHINGLE, np.uint64)])
    whole, p = np.zeros(len(words), np.uint64), 1
    for k in range(SHINGLE):
        whole += padded[k : k + len(words)] * np.uint64(p)
        p = p * P % (1 << 64)
    for k in np.flatnonzero((n > 0) & (n < SHINGLE)):  # its words only
        at = np.uint64(0)
        for j, w in enumerate(words[first[k] : first[k + 1]]):
            at += w * np.uint64(pow(P, j, 1 << 64))
        whole[first[k]] = at
    begin = np.cumsum(counts) - counts
    take = np.arange(counts.sum()) + np.repeat(first[:-1] - begin, counts)
    out = whole[take]
    out ^= out >> np.uint64(31)
    out *= np.uint64(Q)
    out ^= out >> np.uint64(32)
    return out, counts


def different(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the different shingles of each text in ascending order, the text of each, and how many each text has."""
    with np.errstate(over="ignore"):
        hashes, counts = shingles_of(texts)
    owner = np.repeat(np.arange(len(texts)), counts)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])])[: len(hashes)]
    hashes, owner = hashes[new], owner[new]
    return hashes, owner, np.bincount(owner, minlength=len(texts))


def jaccard(a: bytes, b: bytes) -> float:
    """Of the two shingle sets; two texts without a shingle are alike."""
    with np.errstate(over="ignore"):
        hashes, counts = shingles_of([a, b])
    x, y = np.unique(hashes[: counts[0]]), np.unique(hashes[counts[0] :])
    both = len(np.intersect1d(x, y, assume_unique=True))
    union = len(x) + len(y) - both
    return both / union if union else 1.0


def by_size(texts, most: int = CHUNK):
    """Lists of neighbouring texts of about ``most`` bytes."""
    part, held = [], 0
    for t in texts:
        if part and held + len(t) > most:
            yield part
            part, held = [], 0
        part.append(t)
        held += len(t) + 1
    if part:
        yield part
