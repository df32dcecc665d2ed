"""Banded alignment of a pattern with any region of a sequence."""

from __future__ import annotations

import numpy as np


def banded_alignment(own: np.ndarray, other: np.ndarray, low: int, high: int, budget: int):
    """``(edits, start, end)`` of the region of ``other`` nearest to all of ``own``.

    Only places whose diagonal (place in ``other`` - place in ``own``) is in ``low..high`` are
    visited.  None if every region takes more than ``budget`` edits; of equally near regions
    the first in the band is returned.
    """
    first, last = max(0, low), min(len(other), high + len(own))
    if first >= last:
        return None
    other = other[first:last]
    width = high - low + 1
    slide = np.arange(width)
    places = low - first + slide
    far = len(own) + len(other) + 1
    cost = np.where((places >= 0) & (places <= len(other)), 0, far)
    start = np.clip(places, 0, len(other))
    for i in range(1, len(own) + 1):
        # Column j of row i stands for the place j + i, so the diagonal stays in its column.
        here = places + i
        inside = (here >= 1) & (here <= len(other))
        same = np.zeros(width, bool)
        same[inside] = other[here[inside] - 1] == own[i - 1]
        step = np.where(inside, cost + ~same, far)
        origin = start.copy()
        up = np.append(cost[1:], far) + 1
        up[(here < 0) | (here > len(other))] = far
        better = up < step
        step[better] = up[better]
        origin[better] = np.append(start[1:], 0)[better]
        # Along the row: a running minimum of cost less distance; the origin follows its place.
        level = step - slide
        lowest = np.minimum.accumulate(level)
        source = np.maximum.accumulate(np.where(level == lowest, slide, 0))
        moved = (lowest < level) & inside
        cost = np.where(moved, lowest + slide, step)
        start = np.where(moved, origin[source], origin)
        if cost.min() > budget:
            return None
    end = int(np.argmin(cost))
    if cost[end] > budget:
        return None
    return int(cost[end]), first + int(start[end]), first + int(places[end]) + len(own)
