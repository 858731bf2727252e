"""Words and word shingles of many texts at once, as 64-bit hashes.

A word is a run of characters other than ASCII blanks, controls and punctuation, lower-cased. Everything is computed from the
bytes of the texts, so results are the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .common import mix64, multipliers

WORDS = 5
PIECE = 1 << 20
_TABLE = np.ones(256, bool)
_TABLE[:48] = _TABLE[58:65] = _TABLE[91:97] = _TABLE[123:128] = False
_POWERS = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, np.uint64))


def pieces(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts, PIECE characters or one text at a time."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= PIECE):
            size += len(texts[to])
            to += 1
        yield at, to
        at = to


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word, and the number of the first word of each text (and that of the end)."""
    encoded = [t.lower().encode() for t in texts]
    raw = np.frombuffer(b"\n".join(encoded) + b"\n", np.uint8)
    inside = _TABLE[raw]
    edge = np.diff(inside.view(np.int8), prepend=0)
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    ends = np.cumsum([len(e) + 1 for e in encoded])
    bounds = np.concatenate([[0], np.searchsorted(first, ends)])
    if not len(first):
        return np.zeros(0, np.uint64), bounds
    size = last - first
    at = np.flatnonzero(inside)
    begin = np.cumsum(size) - size
    offset = np.arange(len(at)) - np.repeat(begin, size)
    if offset.max() >= len(_POWERS):
        offset %= len(_POWERS)
    value = (raw[at].astype(np.uint64) + np.uint64(1)) * _POWERS[offset]
    return mix64(np.add.reduceat(value, begin) + size.astype(np.uint64)), bounds


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each shingle of k words, and the bounds of the texts; a text of 1 to k - 1 words is one shingle."""
    n = np.diff(bounds)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    out = np.concatenate([[0], np.cumsum(count)])
    start = np.repeat(bounds[:-1] - out[:-1], count) + np.arange(out[-1])
    limit = np.repeat(bounds[1:], count)
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    mult, _ = multipliers(5, k)
    total = np.zeros(len(start), np.uint64)
    for j in range(k):
        total += np.where(start + j < limit, padded[start + j], np.uint64(0)) * mult[j]
    return mix64(total), out


def fingerprints(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """128 bits of each text's sequence of words, as bytes: (texts, 16) of u8."""
    n = np.diff(bounds)
    place = (np.arange(len(words)) - np.repeat(bounds[:-1], n)).astype(np.uint64)
    out = np.zeros((len(n), 2), np.uint64)
    some = np.flatnonzero(n)
    for j, salt in enumerate((0x243F6A8885A308D3, 0x13198A2E03707344)):
        x = mix64(words ^ mix64(place + np.uint64(salt)))
        if len(some):
            out[some, j] = np.add.reduceat(x, bounds[some])
    out[:, 0] = mix64(out[:, 0] + n.astype(np.uint64))
    return out.view(np.uint8).reshape(-1, 16)
