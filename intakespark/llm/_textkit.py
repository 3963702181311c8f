"""Vectorised hashing of words and character n-grams of whole texts, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_ODD = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n fixed 64-bit values drawn from a counter."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * np.uint64(_ODD))


BYTE = constants(256, 1)
_STEP = int(constants(1, 2)[0]) | 1
_BACK = pow(_STEP, -1, 1 << 64)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the step and of its inverse modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        out = []
        for base in (_STEP, _BACK):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            out.append(np.multiply.accumulate(row))
        if size > 1 << 22:
            return out[0], out[1]
        _powers = (out[0], out[1])
    return _powers


def _chunk(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(data, np.uint8)
    gap = SPACE[raw]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    bounds = np.concatenate(([0] if not gap[0] else [], edge, [len(raw)] if not gap[-1] else [])).astype(np.int64)
    starts, ends = bounds[::2], bounds[1::2]
    forth, back = powers(len(raw))
    sums = np.empty(len(raw) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(BYTE[raw] * forth[: len(raw)], out=sums[1:])
    lengths = (ends - starts).astype(np.uint64)
    return starts, mix((sums[ends] - sums[starts]) * back[starts] + lengths * np.uint64(_ODD))


def word_hashes(data: bytes, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(start of each word, hash of each word) in order, for stretches of about ``most`` bytes cut at white space."""
    at = 0
    while at < len(data):
        end = min(len(data), at + most)
        while end < len(data) and not SPACE[data[end]]:
            end += 1
        starts, hashes = _chunk(data[at:end])
        yield starts + at, hashes
        at = end


def document_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of all texts in order, offsets of each text's words). A-Z is lower-cased first."""
    joined = b" ".join(t.translate(LOWER) for t in texts)
    parts = list(word_hashes(joined))
    starts = np.concatenate([p[0] for p in parts]) if parts else np.empty(0, np.int64)
    hashes = np.concatenate([p[1] for p in parts]) if parts else np.empty(0, np.uint64)
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    begins = np.concatenate(([0], np.cumsum(lengths)))
    return hashes, np.searchsorted(starts, begins)


_PLACE = constants(8, 3)


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit hashes; a shorter text's whole sequence is its one shingle."""
    hashes, at = document_words(texts)
    if words > len(_PLACE) - 1:
        raise ValueError(f"shingles of at most {len(_PLACE) - 1} words")
    if len(hashes) >= words:
        rolled = sum((hashes[k : len(hashes) - words + 1 + k] * _PLACE[k] for k in range(1, words)), hashes[: len(hashes) - words + 1] * _PLACE[0])
        rolled = mix(rolled)
    else:
        rolled = np.empty(0, np.uint64)
    out = []
    for low, high in zip(at[:-1].tolist(), at[1:].tolist()):
        n = high - low
        if n >= words:
            out.append(np.unique(rolled[low : high - words + 1]))
        elif n:
            short = np.full(1, n, np.uint64) * _PLACE[-1]
            for k in range(n):
                short = short + hashes[low + k : low + k + 1] * _PLACE[k]
            out.append(mix(short))
        else:
            out.append(np.empty(0, np.uint64))
    return out
