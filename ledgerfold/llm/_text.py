"""Words and shingles of many texts at once, as 64-bit hashes in numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.Generator(np.random.PCG64(20))
_BYTE = _RNG.integers(1, 2**64, 256, np.uint64) | np.uint64(1)
_BASE = _RNG.integers(1, 2**64, 1, np.uint64)[0] | np.uint64(1)
_SLOT = _RNG.integers(1, 2**64, 64, np.uint64) | np.uint64(1)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of text hashed at once; it bounds the arrays, not the texts.
_BLOCK = 1 << 20


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Arrow batches in smaller pieces, so that a task holds few texts as Python strings at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads them."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _pieces(raw: bytes) -> Iterator[bytes]:
    """Cuts a very long text after blanks, so that no word is cut."""
    at = 0
    while len(raw) - at > _BLOCK:
        end = max(raw.rfind(b" ", at, at + _BLOCK), raw.rfind(b"\n", at, at + _BLOCK))
        if end <= at:
            found = [x for x in (raw.find(b" ", at + _BLOCK), raw.find(b"\n", at + _BLOCK)) if x >= 0]
            end = min(found, default=len(raw) - 1)
        yield raw[at : end + 1]
        at = end + 1
    yield raw[at:]


def _hash_words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word of ``raw``."""
    a = np.frombuffer(raw, np.uint8)
    full = ~_BLANK[a]
    edge = np.diff(full.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    size = ends - starts
    first = np.cumsum(size) - size
    powers = np.cumprod(np.full(int(size.max()), _BASE, np.uint64))
    at = np.arange(int(size.sum())) - np.repeat(first, size)
    value = _BYTE[_LOWER[a[full]]] * powers[at]
    return mix(np.add.reduceat(value, first) + size.astype(np.uint64) * _SLOT[63]), starts


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def word_hashes(texts: list[str | None] | list[bytes]) -> Iterator[np.ndarray]:
    """For each text, the hashes of its words ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered. Null: none."""
    raws = [t if isinstance(t, bytes) else utf8(t) for t in texts]
    i = 0
    while i < len(raws):
        j, total = i, 0
        while j < len(raws) and (j == i or total + len(raws[j]) <= _BLOCK):
            total += len(raws[j]) + 1
            j += 1
        if j == i + 1 and len(raws[i]) > _BLOCK:
            yield np.concatenate([_hash_words(p)[0] for p in _pieces(raws[i])])
        else:
            hashes, starts = _hash_words(b"\n".join(raws[i:j]))
            ends = np.cumsum([len(r) + 1 for r in raws[i:j]])
            cuts = np.searchsorted(starts, ends)
            for k, cut in enumerate(cuts):
                yield hashes[cuts[k - 1] if k else 0 : cut]
        i = j


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of ``k`` words in order; of fewer words, the whole sequence as one; of none, none."""
    n = len(words)
    if not n:
        return words
    k = min(k, n)
    out = np.full(n - k + 1, np.uint64(k), np.uint64)
    for i in range(k):
        out += words[i : n - k + 1 + i] * _SLOT[i]
    return mix(out)
