"""Columns of 64-bit integers as compressed byte planes, so that millions of entries cross a shuffle as a few rows."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa

_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_S29, _S32 = np.uint64(29), np.uint64(32)


def mix(x: np.ndarray, by: np.uint64 = _P) -> np.ndarray:
    x = (x ^ (x >> _S32)) * by
    return x ^ (x >> _S29)


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of what a stands for followed by what b stands for."""
    return mix(a * _Q + b)


def pack(*columns: np.ndarray) -> bytes:
    """Columns of one length: the k-th bytes of all entries of a column lie together, so that bytes which hardly change cost nothing."""
    n = len(columns[0])
    planes = b"".join(np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(n, 8).T).tobytes() for c in columns)
    return struct.pack("<II", n, len(columns)) + pa.Codec("zstd", compression_level=1).compress(planes, asbytes=True)


def unpack(data: bytes, kind: type = np.uint64) -> list[np.ndarray]:
    n, width = struct.unpack_from("<II", data)
    planes = np.frombuffer(pa.Codec("zstd").decompress(memoryview(data)[8:], decompressed_size=8 * n * width), np.uint8).reshape(width, 8, n)
    return [np.ascontiguousarray(p.T).view(kind).reshape(n) for p in planes]


def range_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Which of so many equal ranges of the 64-bit hashes each one is in."""
    return ((hashes >> _S32) * np.uint64(parts)) >> _S32


def cuts(sorted_parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted numbers: each distinct one, and where its stretch begins, with the end of the last."""
    begin = np.flatnonzero(np.concatenate([[True], sorted_parts[1:] != sorted_parts[:-1]])) if len(sorted_parts) else np.zeros(0, np.int64)
    return sorted_parts[begin], np.append(begin, len(sorted_parts))
