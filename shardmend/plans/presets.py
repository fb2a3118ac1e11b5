"""Stories of damage as recipes: how bad from 0 to 1, and a seed.

Only stories whose steps need no decoded picture are here. Those that take another payload get the next one of the pool.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from shardmend.functions.prng import mix32_int
from shardmend.plans.recipe import Recipe, Step
from shardmend.plans.step_catalogue import clamped


def between(a: float, b: float, bad: float) -> float:
    return a + (b - a) * bad


def whole(a: float, b: float, bad: float) -> int:
    return math.floor(between(a, b, bad) + 0.5)


def seed_for(seed: int, i: int) -> int:
    """The seed of the i-th step of a story."""
    return ((seed ^ 0x5BD1E995) * (i + 1) ^ seed >> 7) & 0xFFFFFFFF


def seed_unit(seed: int, i: int) -> float:
    """A number in [0, 1) that stays the same however bad it gets."""
    return mix32_int(seed_for(seed, i)) / 4294967296


def _ransomware(bad: float, seed: int) -> list[tuple[int, str, dict]]:
    kb = whole(1, 14, bad)
    return [(1, "ransomware_partial", {"kb": kb}), (2, "header_graft", {"skip": kb * 1024, "neutralise_markers": True})]


def _wrong_size(bad: float, seed: int) -> list[tuple[int, str, dict]]:
    sign = -1 if seed_unit(seed, 1) < 0.5 else 1
    return [(1, "sof_dims", {"width": 0, "height": 0, "width_delta": sign * (8 + whole(0, 56, bad)), "height_delta": 0})]


# The steps of each story by number, and the ranges that they run through as it gets worse.
STORIES: dict[str, Callable[[float, int], list[tuple[int, str, dict]]]] = {
    "dead-sd": lambda bad, seed: [
        *([(1, "splice", {"clusters": whole(1, 4, bad)})] if bad > 0.25 else []),
        (2, "byte_delete", {"count": whole(1, 6, bad)}),
        (3, "truncate", {"percent": whole(97, 86, bad)}),
    ],
    "header-graft": lambda bad, seed: [(1, "header_graft", {}), *([(2, "byte_delete", {"count": whole(1, 4, bad)})] if bad > 0.2 else [])],
    "interrupted": lambda bad, seed: [(1, "interrupted_download", {"percent": whole(90, 15, bad)})],
    "ftp-ascii": lambda bad, seed: [(1, "ftp_ascii", {"portion": between(0.05, 1, bad)})],
    "ransomware": _ransomware,
    "cosmic": lambda bad, seed: [(1, "bitflip", {"rate": between(0.5, 40, bad * bad)})],
    "email-1998": lambda bad, seed: [(1, "base64_damage", {"lines": whole(1, 6, bad * 2)})] if bad < 0.5 else [(1, "seven_bit", {"start": whole(90, 30, bad)})],
    "wrong-size": _wrong_size,
    "flaky-reader": lambda bad, seed: [(1, "dropped_sectors", {"count": whole(1, 10, bad)}), *([(2, "stutter_read", {"count": whole(0, 4, bad)})] if whole(0, 4, bad) else [])],
    # Not from a list of known stories, but of the same kind.
    "worn-flash": lambda bad, seed: [(1, "flash_fault", {"mode": "burst", "count": whole(1, 8, bad), "page_kb": 2})],
}


def story(name: str, bad: float, seed: int) -> Recipe:
    """The recipe of a story, clamped to what its steps take; each step has a seed of its own, made from the story's."""
    return Recipe([clamped(Step(id_, params, seed_for(seed, i))) for i, id_, params in STORIES[name](min(max(bad, 0.0), 1.0), seed)])
