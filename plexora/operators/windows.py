"""Sliding windows over value-ordered observations."""

from __future__ import annotations

import math


def _half_away(x: float) -> int:
    return math.floor(x + 0.5)


def windows(n: int, least: int, most: int, grow: int, slide: int) -> list[tuple[int, int]]:
    """Half-open ``[start, end)`` windows over ``n`` sorted values.

    Sizes run from ``least`` to ``most`` in steps of ``grow``, starts in steps of
    ``slide``. No window reaches the last value: that one is only part of the
    full range, which callers add themselves.
    """
    if least < 2:
        raise ValueError("a window needs two values at least")
    if not least <= most <= n:
        raise ValueError("window sizes must rise and not exceed the number of values")
    if grow < 1 or slide < 1:
        raise ValueError("steps must be one at least")
    out = []
    for size in range(least, most + 1, grow):
        starts = range(0, max(0, n - size), slide)
        out.extend((s, s + size) for s in starts if s + size <= n - 1)
    return out


def ratio_windows(n: int, least: float = 0.33, most: float = 0.98, grow: float = 0.07, slide: float = 0.07) -> list[tuple[int, int]]:
    """Windows whose sizes and steps are shares of ``n``, rounded half away from zero."""
    if not 0 < least < most < 1 or grow <= 0 or slide <= 0:
        raise ValueError("shares must satisfy 0 < least < most < 1 with positive steps")
    if n <= 10:
        raise ValueError("more than ten values are needed")
    return windows(n, *(_half_away(n * r) for r in (least, most, grow, slide)))
