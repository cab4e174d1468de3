"""Word shingles of whole texts as 64-bit hashes, computed with arrays over a batch of texts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

_U = np.uint64
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 2**64)
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE = _BYTE[_LOWER]
_BYTE[_SPACE] = 0  # a sum from one word's start to the next one's is that word's
BATCH_BYTES = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_ODD, BATCH_BYTES), _powers(_INVERSE, BATCH_BYTES)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(33))
    h *= _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(29)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(32)
    return h


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of each word of the bytes; A-Z count as a-z."""
    raw = np.frombuffer(data, np.uint8)
    inside = np.concatenate([[False], ~_SPACE[raw], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), start
    up, down = (_UP, _DOWN) if len(raw) <= BATCH_BYTES else (_powers(_ODD, len(raw)), _powers(_INVERSE, len(raw)))
    value = np.take(_BYTE, raw)
    value *= up[: len(raw)]
    return mix(np.add.reduceat(value, start) * down[start] + (end - start).astype(np.uint64)), start


def distinct(values: np.ndarray) -> np.ndarray:
    """The sorted distinct values; the array is sorted in place."""
    values.sort()
    new = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return values[new]


def grouped(texts: Sequence[str | None]) -> Iterator[list[bytes]]:
    """The texts' bytes in runs of about BATCH_BYTES; a longer text is a run of its own."""
    run, size = [], 0
    for t in texts:
        data = (t or "").encode("utf-8", "surrogatepass")
        if run and size + len(data) + 1 > BATCH_BYTES:
            yield run
            run, size = [], 0
        run.append(data)
        size += len(data) + 1
    if run:
        yield run


def shingle_sets(texts: Sequence[str | None], width: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its `width`-word shingles; shorter texts have their whole word
    sequence as the only one, texts without words none."""
    for run in grouped(texts):
        words, start = word_hashes(b" ".join(run))
        at = np.cumsum([0] + [len(d) + 1 for d in run])
        first = np.searchsorted(start, at)
        h = np.zeros(max(len(words) - width + 1, 0), np.uint64)
        for k in range(width):
            h = mix(h * _U(_ODD) + words[k : k + len(h)])
        for lo, hi in zip(first[:-1], first[1:]):
            n = hi - lo
            if n >= width:
                yield distinct(h[lo : hi - width + 1].copy())  # the next text's first windows overlap
            elif n:
                code = _U(n)
                for w in words[lo:hi]:
                    code = mix(np.array([code], np.uint64) * _U(_ODD) + w)[0]
                yield np.array([code], np.uint64)
            else:
                yield np.zeros(0, np.uint64)
