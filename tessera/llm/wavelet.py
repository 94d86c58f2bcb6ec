"""Wavelet matrix over a sequence of token ids, with a one-file binary form.

A matrix of ``bits`` bit-planes.  Plane 0 holds the highest bit of every token in sequence
order; the sequence is then stably split by that bit (zeros first) and the next plane holds
the next bit of the split sequence, and so on.  With rank over the planes it gives the token
at a position, how often a token occurs before a position, and with select where its k-th
occurrence is, each in ``bits`` steps and without unpacking the sequence.

File layout (little-endian): magic ``TSWM1``, then ``<HQQ`` bits, tokens, documents; then
five zstd blocks, each preceded by its length as ``<Q``: document ids (int64), a byte for
each document that is 1 if its id is null, tokens of each document (uint32), zeros in each plane (uint64), and the planes, each
packed to whole bytes.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import zstandard

MAGIC = b"TSWM1"
_BLOCK = 512
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


@dataclass
class WaveletMatrix:
    bits: int
    n: int
    zeros: np.ndarray  # uint64[bits]
    planes: list[np.ndarray]  # packed bits, uint8
    _ranks: dict | None = None

    @classmethod
    def build(cls, tokens: np.ndarray, bits: int) -> WaveletMatrix:
        kind = np.uint16 if bits <= 16 else np.uint32
        x = np.ascontiguousarray(tokens, kind)
        planes, zeros = [], np.zeros(bits, np.uint64)
        for k in range(bits):
            one = (x & kind(1 << (bits - 1 - k))) != 0
            planes.append(np.packbits(one))
            low = x.compress(~one)
            zeros[k] = len(low)
            x = np.concatenate([low, x.compress(one)])
        return cls(bits, len(tokens), zeros, planes)

    def _plane(self, k: int) -> np.ndarray:
        return np.unpackbits(self.planes[k], count=self.n).view(bool)

    def decode(self) -> np.ndarray:
        """The whole sequence, by undoing the splits from the last plane to the first."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        x = np.zeros(self.n, kind)
        for k in range(self.bits - 1, -1, -1):
            one, z = self._plane(k), int(self.zeros[k])
            before = np.empty_like(x)
            before[np.flatnonzero(~one)] = x[:z]
            before[np.flatnonzero(one)] = x[z:] | kind(1 << (self.bits - 1 - k))
            x = before
        return x

    def _rank_table(self, k: int) -> np.ndarray:
        """Ones before each block of ``_BLOCK`` bits."""
        if self._ranks is None:
            self._ranks = {}
        if k not in self._ranks:
            ones = _ONES[self.planes[k]].astype(np.int64)
            run = np.concatenate([[0], np.cumsum(ones)])
            self._ranks[k] = run[:: _BLOCK // 8]
        return self._ranks[k]

    def rank1(self, k: int, i: int) -> int:
        """Ones in the first ``i`` bits of plane ``k``."""
        table, block = self._rank_table(k), i // _BLOCK
        first, full = block * (_BLOCK // 8), i // 8
        count = int(table[block]) + int(_ONES[self.planes[k][first:full]].sum())
        if i % 8:
            count += int(_ONES[int(self.planes[k][full]) >> (8 - i % 8)])
        return count

    def _select(self, k: int, bit: int, j: int) -> int:
        """Position of the ``j``-th (from 0) bit equal to ``bit`` in plane ``k``."""
        lo, hi = 0, self.n
        while lo < hi:  # smallest i with j + 1 such bits among the first i + 1
            mid = (lo + hi) // 2
            ones = self.rank1(k, mid + 1)
            if (ones if bit else mid + 1 - ones) >= j + 1:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k in range(self.bits):
            ones = self.rank1(k, i)
            bit = self.rank1(k, i + 1) - ones
            value = value << 1 | bit
            i = int(self.zeros[k]) + ones if bit else i - ones
        return value

    def count(self, token: int, end: int | None = None) -> int:
        """How often ``token`` occurs among the first ``end`` tokens."""
        lo, hi = self._interval(token, self.n if end is None else max(0, min(end, self.n)))
        return hi - lo

    def _interval(self, token: int, end: int) -> tuple[int, int]:
        if token < 0 or token >> self.bits:
            return 0, 0
        lo, hi = 0, end
        for k in range(self.bits):
            a, b = self.rank1(k, lo), self.rank1(k, hi)
            if token >> (self.bits - 1 - k) & 1:
                lo, hi = int(self.zeros[k]) + a, int(self.zeros[k]) + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def locate(self, token: int, j: int) -> int:
        """Position of the ``j``-th (from 0) occurrence of ``token``."""
        lo, hi = self._interval(token, self.n)
        if not 0 <= j < hi - lo:
            raise IndexError(j)
        i = lo + j
        for k in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - k) & 1
            i = self._select(k, bit, i - int(self.zeros[k]) if bit else i)
        return i


def pack(matrix: WaveletMatrix, ids: np.ndarray, null: np.ndarray, lengths: np.ndarray) -> bytes:
    """The file: header, documents and planes."""
    press = zstandard.ZstdCompressor(level=1).compress
    blocks = [
        np.ascontiguousarray(ids, "<i8").tobytes(),
        np.ascontiguousarray(null, np.uint8).tobytes(),
        np.ascontiguousarray(lengths, "<u4").tobytes(),
        np.ascontiguousarray(matrix.zeros, "<u8").tobytes(),
        b"".join(p.tobytes() for p in matrix.planes),
    ]
    out = [MAGIC, struct.pack("<HQQ", matrix.bits, matrix.n, len(lengths))]
    for block in blocks:
        small = press(block)
        out += [struct.pack("<Q", len(small)), small]
    return b"".join(out)


def unpack(data: bytes) -> tuple[WaveletMatrix, np.ndarray, np.ndarray, np.ndarray]:
    """Matrix, document ids, null flags and lengths of a file."""
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("not a wavelet shard")
    at = len(MAGIC)
    bits, n, _ = struct.unpack_from("<HQQ", data, at)
    at += struct.calcsize("<HQQ")
    blocks = []
    for _ in range(5):
        (size,) = struct.unpack_from("<Q", data, at)
        blocks.append(zstandard.ZstdDecompressor().decompress(data[at + 8 : at + 8 + size]))
        at += 8 + size
    ids, null = np.frombuffer(blocks[0], "<i8"), np.frombuffer(blocks[1], np.uint8).astype(bool)
    lengths, zeros = np.frombuffer(blocks[2], "<u4"), np.frombuffer(blocks[3], "<u8")
    width = (n + 7) // 8
    flat = np.frombuffer(blocks[4], np.uint8)
    return WaveletMatrix(bits, n, zeros, [flat[k * width : (k + 1) * width] for k in range(bits)]), ids, null, lengths
