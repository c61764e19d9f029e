"""Seeded hash columns: the only source of randomness in the library.

Unlike ``rand()`` the value depends on the key alone, so a sample is the same
for any partitioning and after any task retry.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SEED = 42
_SPACE = 4294967296.0


def _column(part) -> Column:
    return part if isinstance(part, Column) else F.lit(part)


def hash32(*parts, seed: int = SEED) -> Column:
    """First 32 bits of md5 over the seed and the parts, joined with a vertical bar."""
    key = F.concat_ws("|", F.lit(str(seed)), *[_column(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")


def md5_words(*parts, seed: int = SEED) -> Column:
    """md5 over the seed and the parts as text: four words of eight digits."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[_column(p).cast("string") for p in parts]))


def uniform_slices(*parts, seed: int = SEED) -> list[Column]:
    """Four independent uniform numbers from the four 32-bit words of one md5."""
    words = md5_words(*parts, seed=seed)
    return [F.conv(F.substring(words, 1 + 8 * i, 8), 16, 10).cast("bigint") / F.lit(_SPACE) for i in range(4)]


def uniform(*parts, seed: int = SEED) -> Column:
    """Uniform number in [0, 1) of the parts."""
    return hash32(*parts, seed=seed) / F.lit(_SPACE)
