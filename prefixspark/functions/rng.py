"""The xorshift64* generator, so that seeded training draws the same rows everywhere. Driver-side, a few draws a model."""

from __future__ import annotations

import struct

_MASK = (1 << 64) - 1
# Fixed value: the generator's multiplier.
MULTIPLIER = 0x2545F4914F6CDD1D


class Xorshift64Star:
    def __init__(self, seed: int):
        self.state = (seed & _MASK) | 1

    def next_u64(self) -> int:
        x = self.state
        x ^= x >> 12
        x = (x ^ (x << 25)) & _MASK
        x ^= x >> 27
        self.state = x
        return x * MULTIPLIER & _MASK

    def next_f32(self) -> float:
        """In [0, 1), from 23 bits."""
        bits = (self.next_u64() >> 40) & 0x7FFFFF | 0x3F800000
        return struct.unpack("<f", struct.pack("<I", bits))[0] - 1.0

    def next_bounded(self, bound: int) -> int:
        return self.next_u64() % bound

    def distinct(self, k: int, bound: int) -> list[int]:
        """k different numbers below ``bound``, in the order they are drawn."""
        out: dict[int, None] = {}
        while len(out) < k:
            out.setdefault(self.next_bounded(bound))
        return list(out)
