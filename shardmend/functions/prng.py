"""Seeded draws: a PCG32 stream as arrays, and 32-bit mixing as column expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# The multiplier of the generator, the stream that steps draw from, the mixers' factors.
MULTIPLIER = 6364136223846793005
STEP_STREAM = 0x4A504547
MIX_A, MIX_B = 0x7FEB352D, 0x846CA68B
GROUP_FACTOR, ROUND_FACTOR = 0x9E3779B1, 0x85EBCA6B
_M64 = (1 << 64) - 1


class Pcg32:
    """A PCG32 generator whose draws come many at a time: states are powers of the multiplier, so they need no loop."""

    def __init__(self, seed: int, stream: int = STEP_STREAM):
        self.seed = seed
        self.inc = (stream << 1 | 1) & _M64
        self.state = ((self.inc + seed) * MULTIPLIER + self.inc) & _M64

    def draw(self, n: int) -> np.ndarray:
        """The next ``n`` numbers of 32 bits."""
        if n <= 0:
            return np.zeros(0, np.uint64)
        powers = np.full(n + 1, MULTIPLIER, np.uint64)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(powers[:-1])])
        states = powers * np.uint64(self.state) + sums * np.uint64(self.inc)
        self.state = int(states[-1])
        old = states[:-1]
        x = ((old >> np.uint64(18)) ^ old) >> np.uint64(27) & np.uint64(0xFFFFFFFF)
        turn = old >> np.uint64(59)
        return (x >> turn | x << (np.uint64(32) - turn)) & np.uint64(0xFFFFFFFF)

    def one(self) -> int:
        old = self.state
        self.state = (old * MULTIPLIER + self.inc) & _M64
        x, turn = (old >> 18 ^ old) >> 27 & 0xFFFFFFFF, old >> 59
        return (x >> turn | x << (-turn & 31)) & 0xFFFFFFFF

    def below(self, n: int) -> int:
        """Uniform in [0, n): draws of the incomplete lowest range are thrown away."""
        least = (1 << 32) % n
        while (r := self.one()) < least:
            pass
        return r % n

    def unit(self) -> float:
        return self.one() / 4294967296.0


def multiply32(a: Column, b: Column | int) -> Column:
    """Low 32 bits of a product of two numbers of 32 bits, in steps that fit a BIGINT."""
    b = F.lit(b).cast("long") if isinstance(b, int) else b
    upper = F.shiftleft((a * F.shiftright(b, 16)).bitwiseAND(F.lit(0xFFFF)), 16)
    return (a * b.bitwiseAND(F.lit(0xFFFF)) + upper).bitwiseAND(F.lit(0xFFFFFFFF))


def mix32(h: Column) -> Column:
    """A 32-bit value scattered over all 32 bits."""
    h = multiply32(h.bitwiseXOR(F.shiftright(h, 16)), MIX_A)
    h = multiply32(h.bitwiseXOR(F.shiftright(h, 15)), MIX_B)
    return h.bitwiseXOR(F.shiftright(h, 16))


def repeat_seed(child: Column, group: Column, turn: Column) -> Column:
    """The seed of a repeated step in a turn, from its own and its group's."""
    return mix32(child.bitwiseXOR(multiply32(group, GROUP_FACTOR)).bitwiseXOR(multiply32(turn + 1, ROUND_FACTOR)))


def batch_seed(seed: Column, i: Column) -> Column:
    """The seed of the i-th payload of a batch."""
    return (seed + i).bitwiseAND(F.lit(0xFFFFFFFF))


def mix32_int(h: int) -> int:
    """``mix32`` of a plain number."""
    for shift, factor in ((16, MIX_A), (15, MIX_B)):
        h = (h ^ h >> shift) * factor & 0xFFFFFFFF
    return h ^ h >> 16


def turn_seed(child: int, group: int, turn: int) -> int:
    """``repeat_seed`` for plain numbers, where a recipe is unrolled."""
    return mix32_int((child ^ group * GROUP_FACTOR ^ (turn + 1) * ROUND_FACTOR) & 0xFFFFFFFF)
