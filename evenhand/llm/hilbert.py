"""Places of vectors along a Hilbert curve, for whole batches at a time.

Neighbours along the curve are neighbours in space, so rows in its order make blocks
with narrow ranges in every dimension. The computation is the public transposed form of
the curve's index: Gray code undone plane by plane, then the bits of all dimensions
interleaved from the highest plane down.
"""

from __future__ import annotations

import numpy as np

KEY_BITS = 512  # about so many bits a key


def planes(dims: int) -> int:
    """Bits of each dimension, so that keys stay short."""
    return max(1, min(8, KEY_BITS // max(dims, 1)))


def cells(vectors: np.ndarray, low: float, high: float, bits: int) -> np.ndarray:
    """Cell of every component on a grid of 2 ** ``bits`` steps from ``low`` to ``high``."""
    width = high - low
    scaled = (vectors - low) / width if width > 0 and np.isfinite(width) else np.zeros(vectors.shape)
    return np.clip(scaled * (1 << bits), 0, (1 << bits) - 1).astype(np.uint8)


def hilbert_keys(grid: np.ndarray, bits: int) -> list[bytes]:
    """Key of each row of cells; keys in byte order are the rows in the order of the curve."""
    axes = [grid[:, d].astype(np.uint8).copy() for d in range(grid.shape[1])]
    if not axes:
        return [b""] * len(grid)
    plane = 1 << (bits - 1)
    while plane > 1:
        below = np.uint8(plane - 1)
        for d, axis in enumerate(axes):
            flip = (axis & np.uint8(plane)) != 0
            swap = np.where(flip, 0, (axes[0] ^ axis) & below).astype(np.uint8)
            axes[0] ^= np.where(flip, below, swap).astype(np.uint8)
            if d:
                axis ^= swap
        plane >>= 1
    for d in range(1, len(axes)):
        axes[d] ^= axes[d - 1]
    turn = np.zeros(len(grid), np.uint8)
    plane = 1 << (bits - 1)
    while plane > 1:
        turn ^= np.where(axes[-1] & np.uint8(plane), plane - 1, 0).astype(np.uint8)
        plane >>= 1
    stacked = np.stack([axis ^ turn for axis in axes], axis=1)
    spread = np.stack([(stacked >> b) & 1 for b in range(bits - 1, -1, -1)], axis=1)  # row, plane, dimension
    packed = np.packbits(spread.reshape(len(grid), -1), axis=1)
    return [row.tobytes() for row in packed]
