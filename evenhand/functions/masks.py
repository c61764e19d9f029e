"""Clean-up of pixel masks on runs of set pixels.

A mask is kept as the runs of its rows. Shrinking and growing by a flat disc work on row
intervals and their shifts, and components join the runs of neighbouring rows; no pixel
is visited one by one.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np


@lru_cache(maxsize=16)
def disc(size: int) -> tuple[int, ...]:
    """Half width of a disc of ``size`` rows (odd) in each row, top to bottom."""
    radius = size // 2
    return tuple(int(np.rint(np.sqrt(radius * radius - dy * dy))) for dy in range(-radius, radius + 1))


def _near(mask: np.ndarray, half: int) -> np.ndarray:
    """How many set pixels lie within ``half`` columns of each pixel, and in the image."""
    width = mask.shape[1]
    sums = np.concatenate([np.zeros((len(mask), 1), np.int64), np.cumsum(mask, axis=1, dtype=np.int64)], axis=1)
    at = np.arange(width)
    return sums[:, np.minimum(at + half + 1, width)] - sums[:, np.maximum(at - half, 0)]


def grow(mask: np.ndarray, size: int) -> np.ndarray:
    """Pixels with a set pixel under the disc; nothing is set outside the image."""
    found, radius = np.zeros(mask.shape, bool), size // 2
    for dy, half in zip(range(-radius, radius + 1), disc(size)):
        if abs(dy) < len(mask):
            near = _near(mask, half) > 0
            found[max(0, -dy):len(mask) - max(0, dy)] |= near[max(0, dy):len(mask) - max(0, -dy)]
    return found


def shrink(mask: np.ndarray, size: int) -> np.ndarray:
    """Pixels with only set pixels under the disc, as far as it lies in the image."""
    return ~grow(~mask, size)


def opened(mask: np.ndarray, size: int) -> np.ndarray:
    """Without parts that are narrower than the disc."""
    return grow(shrink(mask, size), size)


def closed(mask: np.ndarray, size: int) -> np.ndarray:
    """With gaps filled that are narrower than the disc."""
    return shrink(grow(mask, size), size)


def row_runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of all stretches of set pixels, row by row."""
    padded = np.zeros((len(mask), mask.shape[1] + 2), np.int8)
    padded[:, 1:-1] = mask
    change = np.diff(padded, axis=1)
    row, start = np.nonzero(change == 1)
    return row, start, np.nonzero(change == -1)[1]


def run_components(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end, component) of all runs; pixels that touch, also by a corner, are of one component.

    A component is named by its first run.
    """
    row, start, end = row_runs(mask)
    n, width = len(row), mask.shape[1] + 2
    name = np.arange(n)
    # Runs of the row above that reach from start - 1 to end: a stretch of consecutive runs.
    low = np.searchsorted(row * width + end, (row - 1) * width + start, side="left")
    high = np.searchsorted(row * width + start, (row - 1) * width + end, side="right")
    count = np.maximum(high - low, 0)
    below = np.repeat(np.arange(n), count)
    above = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
    while True:
        least = name.copy()
        np.minimum.at(least, below, name[above])
        np.minimum.at(least, above, name[below])
        np.minimum.at(least, name, least)  # the first run of each component learns of the smallest name
        least = least[least]
        if (least == name).all():
            return row, start, end, name
        name = least


def largest_component(mask: np.ndarray) -> np.ndarray:
    """The mask of the component with most pixels, the first of equal ones; the mask itself if it is empty."""
    row, start, end, name = run_components(mask)
    if not len(row):
        return mask
    area = np.bincount(name, weights=end - start, minlength=len(row))
    found = np.zeros((len(mask), mask.shape[1] + 1), np.int64)
    for r, a, z in zip(*(x[name == area.argmax()] for x in (row, start, end))):
        found[r, a] += 1
        found[r, z] -= 1
    return np.cumsum(found, axis=1)[:, :-1] > 0


def cleaned(valid: np.ndarray, size: int = 21) -> np.ndarray:
    """A mask of valid pixels without specks, with holes filled, cut to its largest component."""
    return largest_component(closed(opened(valid, size), size))
