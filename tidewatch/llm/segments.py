"""All maximal scoring segments of a sequence in one scan."""

from __future__ import annotations

import numpy as np


def maximal_segments(positions: np.ndarray, values: np.ndarray, drift: float) -> list[tuple[int, int, float]]:
    """(first, last, score) of all maximal scoring segments, in order, by one scan.

    values are the scores at positions (ascending); every token between costs drift. Each segment stays on a stack with the
    running totals before and at its end; a new one joins back to the nearest earlier one that began lower and ended lower.
    """
    stack: list[tuple[int, int, float, float]] = []
    total, previous = 0.0, -1
    for at, value in zip(positions.tolist(), values.tolist(), strict=True):
        total += drift * (at - previous - 1)
        previous = at
        if value <= 0:
            total += value
            continue
        first, low = at, total
        total += value
        while stack:
            k = len(stack) - 1
            while k >= 0 and stack[k][2] >= low:
                k -= 1
            if k < 0 or stack[k][3] >= total:
                break
            first, low = stack[k][0], stack[k][2]
            del stack[k:]
        stack.append((first, at, low, total))
    return [(first, last, high - low) for first, last, low, high in stack]
