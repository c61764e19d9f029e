"""Column expressions for labels, scales, scores and identifiers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from evenhand.functions.arrays import bind, total

# Scale to three strata, Roman skin types, ten-point tone scale.
SCALE_TO_STRATUM = {1: "Light", 2: "Light", 3: "Medium", 4: "Medium", 5: "Dark", 6: "Dark"}
INVERTED_SCALE_TO_STRATUM = {0: "Dark", 1: "Dark", 2: "Medium", 3: "Medium", 4: "Light", 5: "Light"}
ROMAN_TO_THREE = {"I": "Light", "II": "Light", "III": "Medium", "IV": "Medium", "V": "Dark", "VI": "Dark"}
ROMAN_TO_FIVE = {
    "I": "Very Light (MST 1-2)", "II": "Light (MST 3-4)", "III": "Medium (MST 5-6)",
    "IV": "Medium (MST 5-6)", "V": "Dark (MST 7-8)", "VI": "Very Dark (MST 9-10)",
}
MST5_NAMES = [
    "Very Dark (MST 9-10)", "Dark (MST 7-8)", "Medium (MST 5-6)", "Light (MST 3-4)", "Very Light (MST 1-2)",
]
MST5_TO_MST3 = {0: 0, 1: 0, 2: 1, 3: 1, 4: 2}
ITA_INNER_BOUNDS = [-55, -41, -28, -10, 10, 28, 41, 55, 70]
HOST_RULES = [
    ("dermaamin", ["dermaamin"]),
    ("atlas_dermatologico", ["atlasdermatologico", "atlas-dermatologico"]),
]


def map_values(value: Column, mapping: Mapping, otherwise: Column | None = None) -> Column:
    """Lookup in a small literal mapping; unmapped gives ``otherwise`` (NULL)."""
    result = F
    for key, label in mapping.items():
        result = result.when(value == F.lit(key), F.lit(label))
    return result if otherwise is None else result.otherwise(otherwise)


def first_max(values: Column) -> Column:
    """1-based position of the first maximum."""
    return F.array_position(values, F.array_max(values)).cast("int")


def one_hot_label(
    classes: Sequence[str], unknown: str | None = None, include_unknown: bool = False
) -> Column:
    """Class name of a one-hot row, first maximum winning.

    With an ``unknown`` column, rows above 0.5 there become NULL, or the class
    named like the column if ``include_unknown``.
    """
    label = F.element_at(
        F.array(*[F.lit(c) for c in classes]),
        first_max(F.array(*[F.col(c).cast("double") for c in classes])),
    )
    if unknown is None:
        return label
    other = F.lit(unknown) if include_unknown else F.lit(None).cast("string")
    return F.when(F.col(unknown).cast("double") > 0.5, other).otherwise(label)


def one_hot(label: Column, classes: Sequence[str], prefix: str = "") -> dict[str, Column]:
    """One 0/1 float column per class."""
    return {f"{prefix}{c}": (label == F.lit(c)).cast("float") for c in classes}


def to_number(text: Column, low: float | None = None, high: float | None = None) -> Column:
    """Number of a string, NULL if malformed, NaN or outside the closed range."""
    number = F.nanvl(text.try_cast("double"), F.lit(None).cast("double"))
    if low is None and high is None:
        return number
    inside = F.lit(True)
    if low is not None:
        inside = inside & (number >= low)
    if high is not None:
        inside = inside & (number <= high)
    return F.when(inside, number)


def host_class(
    url: Column, rules: Sequence[tuple[str, Sequence[str]]] = HOST_RULES,
    other: str = "other", missing: str = "unknown",
) -> Column:
    """Source class of a URL: the first rule with a matching part wins."""
    lowered = F.lower(url)
    result = F.when(url.isNull(), F.lit(missing))
    for name, parts in rules:
        hit = F.lit(False)
        for part in parts:
            hit = hit | F.contains(lowered, F.lit(part))
        result = result.when(hit, F.lit(name))
    return result.otherwise(F.lit(other))


def mst10_name(value: Column) -> Column:
    """Five-class name of a ten-point rating 1..10 (1 is lightest); others NULL."""
    rating = F.nanvl(value.cast("double"), F.lit(None).cast("double")).cast("int")
    step = F.floor((rating + 1) / 2).cast("int")
    return F.when(
        rating.between(1, 10), F.element_at(F.array(*[F.lit(n) for n in reversed(MST5_NAMES)]), F.greatest(F.least(step, F.lit(5)), F.lit(1)))
    )


def halve_class(value: Column) -> Column:
    """Six classes to three: floor(class / 2)."""
    return F.floor(value / 2).cast("int")


def ita_angle(lightness: Column, b: Column) -> Column:
    """Individual typology angle in degrees."""
    return F.degrees(F.atan2(lightness - 50.0, b))


def ita_to_mst10(ita: Column) -> Column:
    """Bin 0 (darkest) to 9 of an angle; half-open bins, NULL or NaN gives -1."""
    angle = F.nanvl(ita, F.lit(None).cast("double"))
    result = F.when(angle.isNull(), F.lit(-1))
    for index, bound in enumerate(ITA_INNER_BOUNDS):
        result = result.when(angle < bound, F.lit(index))
    return result.otherwise(F.lit(len(ITA_INNER_BOUNDS)))


def ita_to_mst5(ita: Column) -> Column:
    ten = ita_to_mst10(ita)
    return F.when(ten < 0, F.lit(-1)).otherwise(halve_class(ten))


def mst5_name(index: Column) -> Column:
    """Name of a five-class index; anything else is ``unknown``."""
    return map_values(index, dict(enumerate(MST5_NAMES)), F.lit("unknown"))


def add_adjacent(probs: Column, width: int, groups: int) -> Column:
    """Sums of ``width`` neighbouring entries, e.g. six classes to three."""
    return F.array(*[
        sum((probs[g * width + i].cast("double") for i in range(1, width)), probs[g * width].cast("double"))
        for g in range(groups)
    ])


def predicted_class(probs: Column, classes: Sequence[str]) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in classes]), first_max(probs))


def tier(value: Column, threshold: float, high_if_below: bool = False) -> Column:
    """``high`` or ``low`` confidence; a spread is high when it is below the threshold."""
    high = (value < threshold) if high_if_below else (value >= threshold)
    return F.when(high, F.lit("high")).otherwise(F.lit("low"))


def stem(path: Column) -> Column:
    """File name without folder and last suffix."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(name.rlike(r"^.+\.[^.]+$"), F.regexp_extract(name, r"^(.+)\.[^.]+$", 1)).otherwise(name)


def strip_parts(name: Column, parts: Sequence[str]) -> Column:
    """Remove literal parts one after the other."""
    for part in parts:
        name = F.replace(name, F.lit(part), F.lit(""))
    return name


def significance_stars(p: Column) -> Column:
    return (
        F.when(p < 0.001, F.lit("***")).when(p < 0.01, F.lit("**")).when(p < 0.05, F.lit("*"))
        .when(p.isNull(), F.lit(None).cast("string")).otherwise(F.lit("ns"))
    )


def safe_name(name: Column) -> Column:
    """Lower-case artifact name: spaces to underscores, ``=()`` removed."""
    return F.lower(F.translate(name, " =()", "_"))


def softmax(scores: Column) -> Column:
    """Softmax of an array, shifted by its maximum."""
    exps = bind(F.array_max(scores), lambda top: F.transform(scores, lambda x: F.exp((x - top).cast("double"))))
    return bind(exps, lambda e: bind(total(e), lambda t: F.transform(e, lambda x: x / t)))
