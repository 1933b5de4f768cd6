"""Vectorised word hashing and min-hashing over batches of texts.

A batch is one byte array; words, their hashes and their shingles come from
whole-array operations, so there is no Python loop over words.  A word is a run
of ASCII letters, digits and bytes of multi-byte UTF-8 characters, in lower case.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BYTES = np.zeros(256, np.uint8)
_BYTES[48:58] = np.arange(48, 58)
_BYTES[97:123] = np.arange(97, 123)
_BYTES[65:91] = np.arange(97, 123)
_BYTES[128:] = np.arange(128, 256)

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)
#: Bytes of text handled at once; longer texts are one chunk of their own.
CHUNK = 1 << 20
_powers: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads each input bit over all 64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: np.uint64, name: str, n: int) -> np.ndarray:
    if name not in _powers or len(_powers[name]) < n:
        full = np.full(n, base, np.uint64)
        full[0] = 1
        np.multiply.accumulate(full, out=full)
        if n > 4 * CHUNK:
            return full
        _powers[name] = full
    return _powers[name][:n]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, and where each text's words start (n + 1 offsets)."""
    parts = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    at = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=at[1:])
    data = _BYTES[np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)]
    inside = np.empty(len(data) + 1, bool)
    inside[0] = False
    np.not_equal(data, 0, out=inside[1:])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[0::2], edge[1::2]
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(data * _power(_P, "p", len(data)), out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * _power(_P_INV, "i", len(data))[starts]
    return mix64(hashes + (ends - starts).astype(np.uint64)), np.searchsorted(starts, at)


def string_hashes(words: list[str]) -> np.ndarray:
    """64-bit hashes of strings without line ends."""
    data = np.frombuffer("\n".join(words).encode("utf-8", "surrogatepass"), np.uint8) if words else np.zeros(0, np.uint8)
    at = np.flatnonzero(data == 10)
    starts, ends = np.r_[0, at + 1][: len(words)], np.r_[at, len(data)][: len(words)]
    return run_hashes(data.astype(np.uint64) + np.uint64(1), starts, ends)


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of values."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power(_P, "p", len(values)), out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * _power(_P_INV, "i", len(values) + 1)[starts]
    return mix64(hashes + (ends - starts).astype(np.uint64))


def shingles(hashes: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of n words; a text of 1 to n - 1 words is one shingle."""
    total = len(hashes)
    if total == 0 or n == 1:
        return hashes, offsets
    out = hashes.copy()
    for j in range(1, n):
        out *= _STEP
        out[: total - j] += hashes[j:]
    lengths = np.diff(offsets)
    keep = np.zeros(total + 1, np.int32)
    last = np.maximum(offsets[1:] - n + 1, offsets[:-1])
    np.add.at(keep, offsets[:-1], 1)
    np.add.at(keep, last, -1)
    kept = np.cumsum(keep[:-1]) > 0
    for d in np.flatnonzero((lengths > 0) & (lengths < n)):
        value = np.uint64(lengths[d])
        with np.errstate(over="ignore"):
            for h in hashes[offsets[d] : offsets[d + 1]]:
                value = value * _STEP + h
        out[offsets[d]] = value
        kept[offsets[d]] = True
    counts = np.where(lengths >= n, lengths - n + 1, np.minimum(lengths, 1))
    where = np.zeros(len(offsets), np.int64)
    np.cumsum(counts, out=where[1:])
    return mix64(out[kept]), where


def permutations(k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 1 << 63, k, dtype=np.uint64)


def minima(values: np.ndarray, offsets: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k 32-bit minima for each text; all bits set where it has no value."""
    out = np.full((len(offsets) - 1, k), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if len(full):
        starts = offsets[:-1][full]
        for j, (a, b) in enumerate(zip(*permutations(k, seed))):
            hashed = values * a
            hashed += b
            hashed >>= np.uint64(32)
            out[full, j] = np.minimum.reduceat(hashed.astype(np.uint32), starts)
    return out


def pack_low_bits(mins: np.ndarray, bits: int) -> np.ndarray:
    """The low bits of the minima, packed: a row of bytes for each text."""
    low = (mins & np.uint32((1 << bits) - 1)).astype(np.uint8)
    per = 8 // bits
    low = low.reshape(len(mins), -1, per)
    out = np.zeros(low.shape[:2], np.uint8)
    for j in range(per):
        out |= low[:, :, j] << np.uint8(j * bits)
    return out


def bands(mins: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of so many minima, different between bands."""
    n, k = mins.shape
    m = mins[:, : k // rows * rows].reshape(n, k // rows, rows).astype(np.uint64)
    key = np.arange(1, k // rows + 1, dtype=np.uint64)[None, :] * _P + np.zeros((n, 1), np.uint64)
    for j in range(rows):
        key = mix64(key * _STEP + m[:, :, j])
    return key.view(np.int64)


def chunks(texts: list[str | None], size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Index ranges of about so many characters."""
    at = total = 0
    for i, t in enumerate(texts):
        total += len(t or "")
        if total >= size:
            yield at, i + 1
            at, total = i + 1, 0
    if at < len(texts):
        yield at, len(texts)
