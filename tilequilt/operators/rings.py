"""Outlines of cell masks."""

from __future__ import annotations

import numpy as np

#: Right, down, left, up: a cell's sides run clockwise (y downwards).
_STEPS = ((1, 0), (0, 1), (-1, 0), (0, -1))


def area(points: list[tuple[float, float]]) -> float:
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:] + points[:1], strict=True))) / 2


def largest_ring(mask: np.ndarray) -> list[tuple[int, int]]:
    """The outline with the largest area of a boolean mask, in cell corners; empty for an empty mask.

    Sides between a selected cell and anything else are walked clockwise, every corner listed. Where two cells touch
    at a corner the walk goes over to the other cell, so they make one ring that touches itself. Holes make rings of
    their own, which are never larger than the one around them.
    """
    padded = np.pad(mask, 1)
    sides: dict[tuple[int, int], list[int]] = {}
    for r, c in zip(*np.nonzero(mask), strict=True):
        r, c = int(r), int(c)
        around = (padded[r, c + 1], padded[r + 1, c + 2], padded[r + 2, c + 1], padded[r + 1, c])
        for d, (other, corner) in enumerate(zip(around, ((c, r), (c + 1, r), (c + 1, r + 1), (c, r + 1)), strict=True)):
            if not other:
                sides.setdefault(corner, []).append(d)
    best: list[tuple[int, int]] = []
    while sides:
        start = at = min(sides)
        ring, direction = [], None
        while True:
            out = sides[at]
            # The leftmost turn first: it leads over a touching corner.
            d = out[0] if direction is None else min(out, key=lambda x: (x - direction + 1) % 4)
            out.remove(d)
            if not out:
                del sides[at]
            ring.append(at)
            at, direction = (at[0] + _STEPS[d][0], at[1] + _STEPS[d][1]), d
            if at == start and at not in sides:
                break
            if at == start and min((x - direction + 1) % 4 for x in sides[at]) >= 2:
                break
        if len(ring) >= 4 and area(ring) > area(best):
            best = ring
    return best
