"""Realism rules, stratum cascade and patch consensus over feature columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from evenhand.functions import arrays as A
from evenhand.functions.arrays import bind, mean
from evenhand.operators.ranking import exact_quantiles, null_safe_join, value_cells
from evenhand.session import settle

# Fixed values: (reason, feature, lower bound, upper bound) in rule order. A rule
# fires when the feature lies strictly between the bounds.
REALISM_RULES = [
    ("border_non_skin_hue", "border_hue_median", 30.0, 160.0),
    ("border_oversaturated", "border_sat_mean", 170.0, None),
    ("too_dark", "border_val_mean", None, 25.0),
    ("center_non_skin_hue", "center_hue_median", 40.0, 150.0),
    ("center_oversaturated", "center_sat_mean", 200.0, None),
    ("green_cast_a", "border_a_mean", None, 105.0),
    ("magenta_cast_a", "border_a_mean", 180.0, None),
    ("blue_cast_b", "border_b_mean", None, 95.0),
    ("extreme_yellow_b", "border_b_mean", 200.0, None),
    ("patchy_a_std", "border_a_std", 35.0, None),
    ("patchy_b_std", "border_b_std", 35.0, None),
    ("center_green_a", "center_a_mean", None, 90.0),
    ("center_blue_b", "center_b_mean", None, 80.0),
]


def realism_reason(rules: Sequence[tuple] = REALISM_RULES) -> Column:
    """``ok`` or ``<rule>=<value>`` of the first rule that fires.

    One ``when`` chain over feature columns, so the thresholds stay visible in the plan.
    """
    result = F
    for name, feature, low, high in rules:
        value = F.col(feature)
        fires = F.lit(True)
        if low is not None:
            fires = fires & (value > low)
        if high is not None:
            fires = fires & (value < high)
        shown = F.bround(value, 0).cast("bigint").cast("string")
        result = result.when(fires, F.concat(F.lit(f"{name}="), shown))
    return result.otherwise(F.lit("ok"))


def mask_is_valid(share: Column, low: float = 0.005, high: float = 0.7) -> Column:
    """A lesion mask must cover between 0.5 % and 70 % of the image."""
    return (share >= low) & (share <= high)


def ring_is_large(pixels: Column, minimum: int = 500) -> Column:
    return pixels >= minimum


def cascade(options: Sequence[tuple[str, Column, Column]], fallback: tuple[str, Column]) -> Column:
    """(method, value) of the first option whose condition holds and whose value exists."""
    result = F
    for name, condition, value in options:
        result = result.when(
            condition & value.isNotNull(), F.struct(F.lit(name).alias("method"), value.alias("value")))
    return result.otherwise(F.struct(F.lit(fallback[0]).alias("method"), fallback[1].alias("value")))


EDGE_GRID = [(r, c) for r in range(3) for c in range(3) if (r, c) != (1, 1)]


def _clip(value: Column, high: Column) -> Column:
    return F.greatest(F.lit(0), F.least(value, high))


def _position(y: Column, x: Column) -> Column:
    return F.struct(y.cast("int").alias("y"), x.cast("int").alias("x"))


def edge_positions(height: Column, width: Column, patch: int, margin: int) -> Column:
    """Eight patch corners: a three by three grid inside the margin, without its middle, row by row."""

    def stops(length: Column) -> list[Column]:
        return [F.lit(margin), F.floor(length / 2) - patch // 2, length - patch - margin]

    rows, columns = stops(height), stops(width)
    return F.array(*[
        _position(_clip(rows[r], height - patch), _clip(columns[c], width - patch))
        for r, c in EDGE_GRID
    ])


def circle_positions(mask: Column, height: Column, width: Column, patch: int) -> Column:
    """Eight patch corners on a circle around the centre of the valid cells; NULL without valid cells."""
    centre = bind(F.array_compact(F.transform(mask, lambda m, i: F.when(m, i))), lambda cells: F.struct(
        mean(F.transform(cells, lambda i: F.floor(i / width).cast("double"))).cast("int").alias("y"),
        mean(F.transform(cells, lambda i: (i % width).cast("double"))).cast("int").alias("x"),
    ))
    radius = (F.lit(0.35) * F.least(height, width)).cast("int")

    def around(c: Column) -> Column:
        spots = []
        for angle in range(0, 360, 45):
            theta = F.radians(F.lit(float(angle)))
            y = (c["y"] + radius * F.sin(theta)).cast("int") - patch // 2
            x = (c["x"] + radius * F.cos(theta)).cast("int") - patch // 2
            spots.append(_position(_clip(y, height - patch), _clip(x, width - patch)))
        return F.when(c["y"].isNotNull(), F.array(*spots))

    return bind(centre, around)


def keep_valid_patches(spots: Column, mask: Column, width: Column, patch: int, min_valid: float) -> Column:
    """Spots whose patch has at least ``min_valid`` valid cells."""

    def valid_cells(spot: Column) -> Column:
        rows = F.transform(F.sequence(F.lit(0), F.lit(patch - 1)), lambda dy: F.size(F.filter(
            F.slice(mask, ((spot["y"] + dy) * width + spot["x"] + 1).cast("int"), F.lit(patch)), lambda m: m)))
        return F.aggregate(rows, F.lit(0), lambda acc, n: acc + n)

    return F.filter(spots, lambda s: valid_cells(s) / float(patch * patch) >= min_valid)


def patch_positions(
    mask: Column, height: Column, width: Column, patch: int = 32, margin: int = 10, min_valid: float = 0.95
) -> Column:
    """Patch corners to sample: valid edge patches, else valid circle patches, else all edge patches."""
    edges = edge_positions(height, width, patch, margin)
    circle = circle_positions(mask, height, width, patch)

    def choose(sets: Column) -> Column:
        return (
            F.when(F.size(sets["edge"]) > 0, sets["edge"])
            .when(F.size(sets["round"]) > 0, sets["round"])
            .otherwise(edges)
        )

    return bind(F.struct(
        keep_valid_patches(edges, mask, width, patch, min_valid).alias("edge"),
        F.coalesce(keep_valid_patches(circle, mask, width, patch, min_valid), F.slice(edges, 1, 0)).alias("round"),
    ), choose)


def array_consensus(values: Column, fence: float = 1.5) -> Column:
    """Struct (n, kept, median, std) of an array of a few values, as :func:`robust_consensus` has them for rows.

    For groups whose size is bounded, like the patches of one image: their values are
    gathered once and need no further shuffle. NULL and NaN are left out.
    """

    def judged(known: Column) -> Column:
        q1, q3 = A.quantile(known, 0.25), A.quantile(known, 0.75)
        return A.bind(F.struct(q1.alias("q1"), q3.alias("q3")), lambda q: A.bind(
            F.filter(known, lambda v: v.between(q["q1"] - fence * (q["q3"] - q["q1"]), q["q3"] + fence * (q["q3"] - q["q1"]))),
            lambda kept: F.struct(F.size(known).alias("n"), F.size(kept).alias("kept"), A.quantile(kept, 0.5).alias("median"),
                                  A.std_pop(kept).alias("std"))))

    return A.bind(F.filter(values, lambda v: v.isNotNull() & ~F.isnan(v)), judged)


def robust_consensus(df: DataFrame, keys: Sequence[str], value: str, fence: float = 1.5) -> DataFrame:
    """(keys, n, kept, median, std): median and population spread of the values inside the IQR fence.

    Works for groups of any size. If the fence removes everything, all values are
    kept; a single value has spread 0. ``keys=[]`` is one group.
    """
    v = F.col(value)
    if not keys:
        whole = df.withColumn("_all", F.when(v.isNotNull(), 1))  # not a constant to the optimizer
        return robust_consensus(whole, ["_all"], value, fence).drop("_all")
    cells = settle(value_cells(df, keys, value), "values")
    bounds = exact_quantiles(cells, keys, value, [0.25, 0.75], weight="n").groupBy(*keys).agg(
        F.max(F.when(F.col("prob") == 0.25, F.col("quantile"))).alias("_q1"),
        F.max(F.when(F.col("prob") == 0.75, F.col("quantile"))).alias("_q3"),
    )
    bounds = settle(bounds, "bounds")
    reach = fence * (F.col("_q3") - F.col("_q1"))
    # The interquartile values always lie inside the fence, so a group never loses all rows.
    fenced = null_safe_join(cells, bounds, keys).withColumn(
        "_in", F.when(v.between(F.col("_q1") - reach, F.col("_q3") + reach), F.col("n")).otherwise(0))
    gap = v - F.col("_q1")  # sums around a value of the group keep the spread accurate
    sums = fenced.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("_in").alias("kept"),
        F.sum(gap * F.col("_in")).alias("_s1"), F.sum(gap * gap * F.col("_in")).alias("_s2"),
    )
    spread = F.col("_s2") / F.col("kept") - F.pow(F.col("_s1") / F.col("kept"), F.lit(2))
    kept = fenced.where(F.col("_in") > 0).select(*keys, value, "n")
    medians = exact_quantiles(kept, keys, value, [0.5], weight="n").select(
        *keys, F.col("quantile").alias("median"))
    return null_safe_join(sums, medians, keys).select(
        *keys, "n", "kept", "median", F.sqrt(F.greatest(spread, F.lit(0.0))).alias("std"))
