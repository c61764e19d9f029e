"""Column expressions over small dense arrays (channels, masks, heat-maps).

An array holds one channel in row-major order. Region index lists are literals,
so a region is a fixed set of array positions known when the plan is built.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row.

    A column referenced inside a lambda is otherwise evaluated for every element.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def mean(values: Column) -> Column:
    """Mean of an array, NULL if empty."""
    return F.try_divide(total(values), F.size(values).cast("double"))


def std_pop(values: Column) -> Column:
    """Population standard deviation, NULL if empty."""
    return bind(
        mean(values), lambda centre: F.sqrt(mean(F.transform(values, lambda x: (x - centre) * (x - centre))))
    )


def quantile(values: Column, prob: float) -> Column:
    """Quantile with linear interpolation, NULL if empty."""

    def interpolate(ordered: Column) -> Column:
        position = (F.size(ordered) - 1) * F.lit(float(prob))
        low = F.get(ordered, F.floor(position).cast("int"))
        high = F.get(ordered, F.ceil(position).cast("int"))
        return F.when(F.size(ordered) > 0, low + (high - low) * (position - F.floor(position)))

    return bind(F.array_sort(values), interpolate)


def median(values: Column) -> Column:
    return quantile(values, 0.5)


def region(values: Column, positions: Sequence[int]) -> Column:
    """Entries at fixed 0-based positions."""
    return F.array(*[F.get(values, F.lit(p)) for p in positions])


def border_positions(height: int, width: int, margin: int | None = None) -> list[int]:
    """Outer ring: an eighth of each side, at least two cells unless ``margin`` says otherwise."""
    mh = margin if margin is not None else max(2, height // 8)
    mw = margin if margin is not None else max(2, width // 8)
    return [
        y * width + x for y in range(height) for x in range(width)
        if y < mh or y >= height - mh or x < mw or x >= width - mw
    ]


def centre_positions(height: int, width: int, half: int | None = None) -> list[int]:
    """Middle box: 15 % of each side around the centre, at least two cells each way."""
    rh = half if half is not None else max(2, int(height * 0.15))
    rw = half if half is not None else max(2, int(width * 0.15))
    rows = range(height // 2 - rh, height // 2 + rh)
    return [y * width + x for y in rows for x in range(width // 2 - rw, width // 2 + rw)]


def where_mask(values: Column, mask: Column) -> Column:
    """Entries whose mask entry is true."""
    kept = F.filter(F.zip_with(values, mask, lambda v, m: F.struct(v.alias("v"), m.alias("m"))), lambda s: s["m"])
    return F.transform(kept, lambda s: s["v"])


def share(mask: Column) -> Column:
    """Share of true entries."""
    return mean(F.transform(mask, lambda m: m.cast("double")))


def transfer_channel(
    values: Column, source_mean: Column, source_std: Column, target_mean: Column, target_std: Column,
    low: float = 0.0, high: float = 255.0, guard: str = "max",
) -> Column:
    """Shift and scale one channel to the target's mean and spread, then clip.

    ``guard="max"`` divides by at least 1e-6, ``guard="one"`` replaces a spread
    below 1e-6 by 1.
    """
    tiny = F.lit(1e-6)
    if guard == "max":
        spread = F.greatest(source_std, tiny)
    elif guard == "one":
        spread = F.when(source_std < tiny, F.lit(1.0)).otherwise(source_std)
    else:
        raise ValueError(f"guard must be max or one, not {guard!r}")
    numbers = F.struct(
        source_mean.alias("from_mean"), (target_std / spread).alias("scale"), target_mean.alias("to_mean")
    )
    return bind(numbers, lambda s: F.transform(values, lambda x: F.least(
        F.greatest((x - s["from_mean"]) * s["scale"] + s["to_mean"], F.lit(low)), F.lit(high)
    )))


def focus_region(cells: Column, height: int | Column, width: int | Column, threshold: float = 0.5) -> Column:
    """Word for the centroid of the cells at or above ``threshold``."""
    h = height if isinstance(height, Column) else F.lit(height)
    w = width if isinstance(width, Column) else F.lit(width)

    def centroid(hot: Column) -> Column:
        return F.struct(
            (mean(F.transform(hot, lambda i: F.floor(i / w).cast("double"))) / h).alias("y"),
            (mean(F.transform(hot, lambda i: (i % w).cast("double"))) / w).alias("x"),
        )

    def words(c: Column) -> Column:
        return F.struct(
            F.when(c["y"] < 0.33, "upper").when(c["y"] > 0.66, "lower").otherwise("center").alias("v"),
            F.when(c["x"] < 0.33, "left").when(c["x"] > 0.66, "right").otherwise("center").alias("h"),
            c["y"].isNull().alias("none"),
        )

    hot = F.array_compact(F.transform(cells, lambda x, i: F.when(x >= threshold, i)))
    return bind(bind(bind(hot, centroid), words), lambda s: (
        F.when(s["none"], F.lit("diffuse"))
        .when(s["v"] == "center", s["h"])
        .when(s["h"] == "center", s["v"])
        .otherwise(F.concat_ws("-", s["v"], s["h"]))
    ))


def intensity_word(cells: Column, floor: float = 0.3) -> Column:
    """strong, moderate or weak by the mean of the cells above ``floor``."""
    level = F.coalesce(mean(F.filter(cells, lambda x: x > floor)), F.lit(0.0))
    return F.when(level > 0.7, F.lit("strong")).when(level > 0.4, F.lit("moderate")).otherwise(F.lit("weak"))
