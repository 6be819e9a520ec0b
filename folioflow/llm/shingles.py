"""Words and word shingles of many texts at once, as 64-bit hashes in numpy.

A word is a run of a-z and 0-9 of the lower-cased text. All functions take a list of whole texts and work on the
concatenated bytes, so that the cost per word is a few vector operations instead of Python calls.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
_WORD_BYTE = np.zeros(256, dtype=bool)
_WORD_BYTE[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
BATCH_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(20, int(n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        up = np.full(size, _BASE, dtype=U)
        down = np.full(size, _BASE_INVERSE, dtype=U)
        up[0] = down[0] = U(1)
        _powers[size] = np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)
    return _powers[size]


def batches(texts: list[str]) -> Iterator[tuple[int, list[bytes]]]:
    """Lower-cased texts in runs of about a megabyte, with the index of the first; a longer text is its own run."""
    run: list[bytes] = []
    size = first = 0
    for k, text in enumerate(texts):
        low = text.lower().encode("utf-8", "replace")
        if run and size + len(low) > BATCH_BYTES:
            yield first, run
            run, size, first = [], 0, k
        run.append(low)
        size += len(low) + 1
    if run:
        yield first, run


def words(lowered: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each text the index of its first word (one entry more than texts)."""
    joined = np.frombuffer(b"\n".join(lowered), dtype=np.uint8)
    ends = np.cumsum([len(x) + 1 for x in lowered])
    if not len(joined):
        return np.zeros(0, U), np.zeros(len(lowered) + 1, np.int64)
    inside = np.concatenate(([False], _WORD_BYTE[joined], [False]))
    change = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = change[::2], change[1::2]
    up, down = _tables(len(joined) + 1)
    prefix = np.zeros(len(joined) + 1, dtype=U)
    np.cumsum((joined.astype(U) + U(1)) * up[: len(joined)], out=prefix[1:])
    hashed = mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(U))
    return hashed, np.concatenate(([0], np.searchsorted(start, ends, side="left")))


def shingles(word: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words that stay in one text, and the index of the first shingle of each text."""
    counts = np.maximum(np.diff(first) - n + 1, 0)
    starts = np.concatenate(([0], np.cumsum(counts)))
    if len(word) < n or not starts[-1]:
        return np.zeros(0, U), np.zeros(len(first), np.int64)
    h = np.zeros(len(word) - n + 1, dtype=U)
    for k in range(n):
        h = mix(h * U(0xD6E8FEB86659FD93) + word[k : len(word) - n + 1 + k] + U(k + 1))
    owner = np.repeat(np.arange(len(counts)), np.diff(first))[: len(h)]
    at = np.arange(len(h))
    return h[at + n <= first[owner + 1]], starts


def sequence_hash(word: np.ndarray, first: np.ndarray, seed: int = 0) -> np.ndarray:
    """One hash for each text's sequence of words."""
    n = np.diff(first)
    at = np.arange(len(word), dtype=np.int64) - np.repeat(first[:-1], n)
    total = np.concatenate((np.zeros(1, U), np.cumsum(mix(word ^ mix(at.astype(U) + U(seed * 1_000_003 + 17))), dtype=U)))
    return mix(total[first[1:]] - total[first[:-1]] + n.astype(U))
