"""Compressed bitmaps over 64-bit ordinals.

Ordinals are cut into chunks of 65,536. A chunk is kept in the smallest of three forms: a sorted array of 16-bit
positions (sparse), runs (start, length) or 8 KB of plain bits (dense). Set operations work chunk by chunk on the plain
bits, so they cost the same whatever the form.
"""

from __future__ import annotations

import struct

import numpy as np

WIDTH = 1 << 16
_ARRAY, _RUNS, _BITS = 0, 1, 2


def _pack(bits: np.ndarray) -> tuple[int, np.ndarray]:
    positions = np.flatnonzero(bits)
    if not len(positions):
        return _ARRAY, positions.astype(np.uint16)
    edges = np.flatnonzero(np.diff(positions) != 1)
    starts = positions[np.r_[0, edges + 1]]
    runs = np.column_stack([starts, positions[np.r_[edges, len(positions) - 1]] - starts]).astype(np.uint16)
    if runs.nbytes <= min(2 * len(positions), WIDTH // 8):
        return _RUNS, runs
    return (_ARRAY, positions.astype(np.uint16)) if 2 * len(positions) <= WIDTH // 8 else (_BITS, np.packbits(bits))


def _unpack(form: int, body: np.ndarray) -> np.ndarray:
    if form == _BITS:
        return np.unpackbits(body).astype(bool)
    bits = np.zeros(WIDTH, bool)
    if form == _ARRAY:
        bits[body] = True
    else:
        steps = np.zeros(WIDTH + 1, np.int32)
        steps[body[:, 0].astype(np.int64)] = 1
        steps[body[:, 0].astype(np.int64) + body[:, 1] + 1] -= 1
        bits = np.cumsum(steps[:WIDTH]) > 0
    return bits


class Bitmap:
    """An immutable set of non-negative ordinals."""

    def __init__(self, chunks: dict[int, tuple[int, np.ndarray]] | None = None):
        self.chunks = chunks or {}

    @classmethod
    def of(cls, ordinals) -> Bitmap:
        ordinals = np.asarray(ordinals, np.int64)
        chunks = {}
        high = ordinals >> 16
        for h in np.unique(high):
            bits = np.zeros(WIDTH, bool)
            bits[ordinals[high == h] & (WIDTH - 1)] = True
            chunks[int(h)] = _pack(bits)
        return cls(chunks)

    def _with(self, other: Bitmap, keys, op) -> Bitmap:
        chunks = {}
        none = np.zeros(WIDTH, bool)
        for k in keys:
            bits = op(_unpack(*self.chunks[k]) if k in self.chunks else none, _unpack(*other.chunks[k]) if k in other.chunks else none)
            if bits.any():
                chunks[k] = _pack(bits)
        return Bitmap(chunks)

    def __and__(self, other: Bitmap) -> Bitmap:
        return self._with(other, self.chunks.keys() & other.chunks.keys(), np.logical_and)

    def __or__(self, other: Bitmap) -> Bitmap:
        return self._with(other, self.chunks.keys() | other.chunks.keys(), np.logical_or)

    def andnot(self, other: Bitmap) -> Bitmap:
        return self._with(other, self.chunks.keys(), lambda a, b: a & ~b)

    def __len__(self) -> int:
        return sum(len(b) if f == _ARRAY else int(b[:, 1].astype(np.int64).sum() + len(b)) if f == _RUNS else int(np.unpackbits(b).sum()) for f, b in self.chunks.values())

    def ordinals(self) -> np.ndarray:
        parts = [np.flatnonzero(_unpack(*self.chunks[k])) + (k << 16) for k in sorted(self.chunks)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def to_bytes(self) -> bytes:
        out = [struct.pack("<I", len(self.chunks))]
        for k in sorted(self.chunks):
            form, body = self.chunks[k]
            raw = np.ascontiguousarray(body).tobytes()
            out += [struct.pack("<QBI", k, form, len(raw)), raw]
        return b"".join(out)

    @classmethod
    def from_bytes(cls, raw: bytes) -> Bitmap:
        (n,), at, chunks = struct.unpack_from("<I", raw), 4, {}
        for _ in range(n):
            k, form, size = struct.unpack_from("<QBI", raw, at)
            at += 13
            body = np.frombuffer(raw, np.uint8 if form == _BITS else np.uint16, offset=at, count=size // (1 if form == _BITS else 2))
            chunks[k] = form, body.reshape(-1, 2) if form == _RUNS else body
            at += size
        return cls(chunks)
