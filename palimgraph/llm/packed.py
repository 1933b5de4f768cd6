"""Arrays of whole numbers as bytes for a shuffle."""

from __future__ import annotations

import struct

import numpy as np


def pack(*arrays: np.ndarray) -> bytes:
    """Whole numbers from 0 on (or the bits of floats), each array in as many bytes as its largest needs, like bytes together."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a.view(np.uint64) if a.dtype.kind == "f" else a.astype(np.uint64))
        width = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
        out += [struct.pack("<QB", len(a), width), a.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()]
    return b"".join(out)


def unpack(raw: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(raw):
        n, width = struct.unpack_from("<QB", raw, at)
        a = np.zeros((n, 8), np.uint8)
        a[:, :width] = np.frombuffer(raw, np.uint8, n * width, at + 9).reshape(width, n).T
        out.append(a.reshape(-1).view(np.int64))
        at += 9 + n * width
    return out


def steps(a: np.ndarray) -> np.ndarray:
    """Differences of ascending numbers, the first as it is."""
    return np.diff(a, prepend=np.int64(0))
