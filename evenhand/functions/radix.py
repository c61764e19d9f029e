"""Order-preserving digits of a double.

``digits(v)`` gives two integers (coarse, fine) such that sorting by
(coarse, fine, v) equals sorting by v. A prefix sum or a rank over all values of
a group can then be taken level by level: no window ever holds a whole group,
whatever the distribution of the values, and no sampling pass is needed.

* coarse: 64 steps per power of two, at most about 140,000 values in all;
* fine: at most about 2**20 values per coarse step;
* below that at most 2**26 distinct doubles remain.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_STEPS = 64
_SHIFT = 70000  # keeps the coarse digit of every positive double positive
_LARGEST = 1.7976931348623157e308
_SMALLEST_EXPONENT = -990  # 2**(26 - exponent) stays finite


def digits(value: Column) -> tuple[Column, Column]:
    v = F.greatest(F.least(value.cast("double"), F.lit(_LARGEST)), F.lit(-_LARGEST))
    size = F.abs(v)
    step = F.floor(F.log2(F.when(size > 0, size).otherwise(1.0)) * _STEPS).cast("bigint")
    coarse = (
        F.when(size == 0, F.lit(0).cast("bigint"))
        .when(v > 0, step + _SHIFT)
        .otherwise(-(step + _SHIFT))
    )
    exponent = F.greatest(F.floor(step / F.lit(float(_STEPS))), F.lit(_SMALLEST_EXPONENT).cast("bigint"))
    fine = F.floor(v * F.pow(F.lit(2.0), (F.lit(26) - exponent).cast("double"))).cast("bigint")
    return coarse, fine
