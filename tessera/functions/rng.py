"""PCG64 random numbers: explicit state, no globals, the same stream for the same seed.

The generator is the published PCG XSL-RR 128/64 (M. O'Neill); seeds are spread by SplitMix64.
Normals use Marsaglia's polar method, gammas Marsaglia and Tsang's.  For plain columns of
random numbers use Spark's own ``rand`` and ``randn``; this class is for streams that must be
reproduced draw by draw.
"""

from __future__ import annotations

import math

import numpy as np

_M64, _M128 = (1 << 64) - 1, (1 << 128) - 1
# Fixed value: the multiplier of the 128-bit linear congruential generator behind PCG64.
_MULTIPLIER = 0x2360ED051FC65DA44385DF649FCCF645


def splitmix64(state: int) -> tuple[int, int]:
    """Next state and output."""
    state = (state + 0x9E3779B97F4A7C15) & _M64
    z = state
    z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _M64
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _M64
    return state, z ^ (z >> 31)


class Rng:
    """A stream of random numbers, chosen by a seed and a stream number."""

    def __init__(self, seed: int, stream: int = 0) -> None:
        mixed, words = seed & _M64, []
        for _ in range(2):
            mixed, out = splitmix64(mixed)
            words.append(out)
        mixed = stream & _M64
        for _ in range(2):
            mixed, out = splitmix64(mixed)
            words.append(out)
        self.increment = ((words[2] << 64 | words[3]) << 1 | 1) & _M128
        self.state = 0
        self._step()
        self.state = (self.state + (words[0] << 64 | words[1])) & _M128
        self._step()
        self._spare: float | None = None

    def _step(self) -> None:
        self.state = (self.state * _MULTIPLIER + self.increment) & _M128

    def u64(self) -> int:
        self._step()
        x = ((self.state >> 64) ^ self.state) & _M64
        turn = self.state >> 122
        return (x >> turn | x << (64 - turn)) & _M64 if turn else x

    def uniform(self) -> float:
        """In [0, 1), 53 bits."""
        return (self.u64() >> 11) * 2.0**-53

    def below(self, n: int) -> int:
        """An unbiased integer in [0, n)."""
        if n <= 0:
            raise ValueError("n must be above zero")
        reject = (1 << 64) % n
        while True:
            product = self.u64() * n
            if product & _M64 >= reject:
                return product >> 64

    def below_many(self, n: int, count: int) -> np.ndarray:
        """What ``count`` calls of ``below(n)`` give, for ``n`` below 2^32; numpy steps the same generator."""
        return self.below_told(n, count)[0]

    def below_told(self, n: int, count: int) -> tuple[np.ndarray, list[int], int]:
        """``below_many``, which of the words it took were rejected (from 0), and how many it took."""
        if not 0 < n < 1 << 32:
            raise ValueError("n must be above zero and below 2^32")
        bits = self._numpy()
        reject, by, half = np.uint64((1 << 64) % n), np.uint64(n), np.uint64(32)
        out, missing, rejected, taken = [np.zeros(0, np.int64)], count, [], 0
        while missing:
            x = bits.random_raw(missing)
            low = x * by
            if low.min() < reject:
                bad = low < reject
                rejected += (taken + np.flatnonzero(bad)).tolist()
                taken, x = taken + missing, x[~bad]
            else:
                taken += missing
            out.append((((x >> half) * by + ((x & np.uint64(0xFFFFFFFF)) * by >> half)) >> half).astype(np.int64))
            missing -= len(x)
        self.state = bits.state["state"]["state"]
        return np.concatenate(out), rejected, taken

    def advance(self, words: int) -> Rng:
        """Skip so many words (back, if below zero) without making them; returns itself."""
        self.state, self._spare = self._numpy().advance(words & _M128).state["state"]["state"], None
        return self

    def _numpy(self) -> np.random.PCG64:
        bits = np.random.PCG64()
        bits.state = {"bit_generator": "PCG64", "state": {"state": self.state, "inc": self.increment}, "has_uint32": 0, "uinteger": 0}
        return bits

    def normal(self) -> float:
        if self._spare is not None:
            out, self._spare = self._spare, None
            return out
        while True:
            u, v = 2 * self.uniform() - 1, 2 * self.uniform() - 1
            s = u * u + v * v
            if 0 < s < 1:
                scale = math.sqrt(-2 * math.log(s) / s)
                self._spare = v * scale
                return u * scale

    def gamma(self, shape: float) -> float:
        """Gamma with scale 1."""
        if shape <= 0:
            raise ValueError("shape must be above zero")
        if shape < 1:
            return self.gamma(shape + 1) * self.uniform() ** (1 / shape)
        d = shape - 1 / 3
        c = 1 / math.sqrt(9 * d)
        while True:
            x = self.normal()
            v = (1 + c * x) ** 3
            if v > 0:
                u = self.uniform()
                if u == 0 or math.log(u) < 0.5 * x * x + d * (1 - v + math.log(v)):
                    return d * v
