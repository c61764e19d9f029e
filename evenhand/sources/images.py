"""Image sources and the per-image feature job.

Spark lists, decodes and partitions the images; Python only sees Arrow batches of
decoded rows and returns feature columns. Rules on the features are plain columns
(:mod:`evenhand.operators.realism`).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evenhand.functions import labels as L
from evenhand.operators.realism import EDGE_GRID

IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "bmp")


def any_case(suffixes: Sequence[str]) -> str:
    """Glob of files with one of the suffixes, in upper, lower or mixed case."""
    letters = ["".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in s) for s in suffixes]
    return "*.{" + ",".join(letters) + "}"


IMAGE_PATTERN = any_case(IMAGE_SUFFIXES)


def list_images(spark: SparkSession, folder: str, pattern: str = IMAGE_PATTERN, recursive: bool = True) -> DataFrame:
    """(path, file, stem, length) of image files; contents are not read."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", str(recursive).lower()).load(folder)
    )
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("file"), L.stem(F.col("path")).alias("stem"), "length")


def resolve_paths(
    items: DataFrame, listing: DataFrame, key: str, suffixes: Sequence[str] = (".jpg", ".png", ".jpeg", ""),
    alternatives: Sequence[tuple[str, Sequence[str]]] = (),
) -> DataFrame:
    """Add ``path``: the first candidate file name that exists, else NULL.

    Candidates are the key plus each suffix, then each alternative column plus its
    own suffixes. One equi-join on the file name and one aggregation per item; the
    items keep all rows.
    """
    candidates = [(F.col(key).cast("string"), s) for s in suffixes]
    candidates += [(F.col(c).cast("string"), s) for c, own in alternatives for s in own]
    names = F.array(*[
        F.struct(F.lit(i).alias("priority"), F.concat(value, F.lit(suffix)).alias("file"))
        for i, (value, suffix) in enumerate(candidates)
    ])
    columns = [key, *[c for c, _ in alternatives if c != key]]
    wanted = items.select(*columns).distinct().select(*columns, F.inline(names)).where(F.col("file").isNotNull())
    found = wanted.join(listing.select("file", "path"), "file").groupBy(key).agg(
        F.min_by("path", F.struct("priority", "path")).alias("path"))
    return items.join(found, key, "left")


def missing_paths(resolved: DataFrame) -> DataFrame:
    """Items without a file, for the missing report."""
    return resolved.where(F.col("path").isNull()).drop("path")


def read_images(
    spark: SparkSession, folder: str | Sequence[str], on_error: str = "skip", placeholder: tuple[int, int, int] | None = None,
    suffixes: Sequence[str] = IMAGE_SUFFIXES,
) -> DataFrame:
    """Decoded images: (path, height, width, channels, data) of files with one of ``suffixes``, in any case.

    ``on_error="skip"`` drops unreadable files, ``"placeholder"`` keeps them as a
    1 x 1 image of the given BGR colour (grey by default).
    """
    if on_error not in ("skip", "placeholder"):
        raise ValueError(f"on_error must be skip or placeholder, not {on_error!r}")
    reader = spark.read.format("image").option("recursiveFileLookup", "true").option("pathGlobFilter", any_case(suffixes))
    images = reader.option("dropInvalid", str(on_error == "skip").lower()).load(folder)
    flat = images.select(
        F.col("image.origin").alias("path"), F.col("image.height").alias("height"),
        F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"),
    )
    if on_error == "skip":
        return flat
    grey = F.lit(bytes(placeholder or (128, 128, 128)))
    bad = F.col("height") < 1
    return flat.select(
        "path", F.when(bad, 1).otherwise(F.col("height")).alias("height"),
        F.when(bad, 1).otherwise(F.col("width")).alias("width"),
        F.when(bad, 3).otherwise(F.col("channels")).alias("channels"),
        F.when(bad, grey).otherwise(F.col("data")).alias("data"),
    )


# --- pixel helpers -----------------------------------------------------------

def to_bgr(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    pixels = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
    return np.repeat(pixels, 3, axis=2) if channels == 1 else pixels[:, :, :3]


def bgr_to_lab(bgr: np.ndarray) -> np.ndarray:
    """CIE L*a*b* (D65) in the 8-bit convention L * 255 / 100, a + 128, b + 128."""
    rgb = bgr[..., ::-1] / 255.0
    linear = np.where(rgb > 0.04045, ((rgb + 0.055) / 1.055) ** 2.4, rgb / 12.92)
    xyz = linear @ np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169],
                             [0.019334, 0.119193, 0.950227]]).T / np.array([0.950456, 1.0, 1.088754])
    f = np.where(xyz > 0.008856, np.cbrt(xyz), 7.787 * xyz + 16.0 / 116.0)
    lightness = np.where(xyz[..., 1] > 0.008856, 116.0 * f[..., 1] - 16.0, 903.3 * xyz[..., 1])
    lab = np.stack([lightness * 2.55, 500.0 * (f[..., 0] - f[..., 1]) + 128.0, 200.0 * (f[..., 1] - f[..., 2]) + 128.0], -1)
    return np.clip(np.rint(lab), 0, 255)


def bgr_to_hsv(bgr: np.ndarray) -> np.ndarray:
    """Hue in half degrees (0..180), saturation and value in 0..255."""
    b, g, r = (bgr[..., i].astype("float64") for i in range(3))
    top, low = np.maximum(np.maximum(r, g), b), np.minimum(np.minimum(r, g), b)
    span = np.where(top > low, top - low, 1.0)
    hue = np.where(top == r, (g - b) / span, np.where(top == g, 2.0 + (b - r) / span, 4.0 + (r - g) / span)) * 30.0
    hue = np.where(top > low, np.where(hue < 0, hue + 180.0, hue), 0.0)
    return np.stack([np.rint(hue) % 180, np.rint(255.0 * (top - low) / np.where(top > 0, top, 1.0)), top], -1)


FEATURES = [
    "L_mean", "L_std", "a_mean", "a_std", "b_mean", "b_std",
    "border_hue_median", "border_sat_mean", "border_val_mean", "center_hue_median", "center_sat_mean",
    "border_a_mean", "border_b_mean", "border_a_std", "border_b_std", "center_a_mean", "center_b_mean",
    "dark_fraction", "ita", "ita_std",
]


@lru_cache(maxsize=64)
def ring_and_centre(height: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Masks of the outer ring (an eighth of each side, two at least) and of the middle box, by slices.

    The box is 15 % of each side to each way, two pixels at least, and cut off at the
    image's edges; of an image without any such pixel it is the ring.
    """
    ring, centre = np.ones((height, width), bool), np.zeros((height, width), bool)
    mh, mw = max(2, height // 8), max(2, width // 8)
    ring[mh:height - mh, mw:width - mw] = False
    rh, rw = max(2, int(height * 0.15)), max(2, int(width * 0.15))
    centre[max(0, height // 2 - rh):height // 2 + rh, max(0, width // 2 - rw):width // 2 + rw] = True
    return ring.ravel(), (centre if centre.any() else ring).ravel()


def pixel_features(bgr: np.ndarray, dark_threshold: float = 18.0, min_pixels: int = 10) -> list[float | None]:
    """Feature values of one image, in the order of ``FEATURES``."""
    height, width = bgr.shape[:2]
    lab, hsv = bgr_to_lab(bgr).reshape(-1, 3), bgr_to_hsv(bgr).reshape(-1, 3)
    spread = np.column_stack([lab.mean(axis=0), lab.std(axis=0)]).ravel()
    border, inside = ring_and_centre(height, width)
    grey = np.rint(bgr.reshape(-1, 3) @ np.array([0.114, 0.587, 0.299]))
    skin = lab[grey > dark_threshold]
    angles = np.degrees(np.arctan2(skin[:, 0] / 2.55 - 50.0, skin[:, 2] - 128.0))
    enough = len(skin) >= min_pixels
    return [
        *spread, np.median(hsv[border, 0]), hsv[border, 1].mean(), hsv[border, 2].mean(),
        np.median(hsv[inside, 0]), hsv[inside, 1].mean(), lab[border, 1].mean(), lab[border, 2].mean(),
        lab[border, 1].std(), lab[border, 2].std(), lab[inside, 1].mean(), lab[inside, 2].mean(),
        float((grey <= dark_threshold).mean()),
        float(np.median(angles)) if enough else None, float(angles.std()) if enough else None,
    ]


def image_features(images: DataFrame, key: str = "path") -> DataFrame:
    """(key, feature columns) of decoded images, one row per image.

    Arrow batches are limited in bytes (``spark.sql.execution.arrow.maxBytesPerBatch``),
    so a worker holds a few large images at a time.
    ``dark_fraction`` is the plain share of dark pixels, without any
    morphological clean-up of the border mask.
    """

    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                [k, *pixel_features(to_bgr(d, h, w, c))]
                for k, h, w, c, d in zip(batch[key], batch["height"], batch["width"], batch["channels"], batch["data"])
            ]
            yield pd.DataFrame(rows, columns=[key, *FEATURES])

    schema = f"`{key}` string, " + ", ".join(f"{f} double" for f in FEATURES)
    return images.select(key, "height", "width", "channels", "data").mapInPandas(compute, schema)


def vignette_flag(dark_fraction: Column, min_fraction: float = 0.02) -> Column:
    return dark_fraction >= min_fraction


# --- patches -----------------------------------------------------------------

def patch_corners(valid: np.ndarray, patch: int, margin: int, min_valid: float) -> list[tuple[int, int]]:
    """Same rule as ``realism.patch_positions`` for a boolean pixel mask."""
    height, width = valid.shape

    def clip(y: int, x: int) -> tuple[int, int]:
        return max(0, min(y, height - patch)), max(0, min(x, width - patch))

    def usable(spots: list[tuple[int, int]]) -> list[tuple[int, int]]:
        return [(y, x) for y, x in spots if valid[y:y + patch, x:x + patch].mean() >= min_valid]

    rows, columns = ([margin, length // 2 - patch // 2, length - patch - margin] for length in (height, width))
    edges = [clip(rows[r], columns[c]) for r, c in EDGE_GRID]
    kept = usable(edges)
    if not kept and valid.any():
        ys, xs = np.nonzero(valid)
        radius = int(0.35 * min(height, width))
        turns = np.radians(np.arange(0, 360, 45))
        kept = usable([
            clip(int(int(ys.mean()) + radius * np.sin(t)) - patch // 2, int(int(xs.mean()) + radius * np.cos(t)) - patch // 2)
            for t in turns])
    return kept or edges


def angles_of(bgr: np.ndarray) -> np.ndarray:
    """Typology angle of every pixel in degrees."""
    lab = bgr_to_lab(bgr)
    return np.degrees(np.arctan2(lab[..., 0] / 2.55 - 50.0, lab[..., 2] - 128.0))


def edge_angles(bgr: np.ndarray, patch: int, margin: int, dark_threshold: float, min_valid: float) -> list[float]:
    """Median angle of each of up to eight patches, dark border avoided."""
    valid = np.rint(bgr @ np.array([0.114, 0.587, 0.299])) > dark_threshold
    size = min(patch, *bgr.shape[:2])
    corners = patch_corners(valid, size, margin, min_valid)
    return [float(np.median(angles_of(bgr[y:y + size, x:x + size]))) for y, x in corners]


def _per_image(images: DataFrame, key: str, compute, schema: str, extra: Sequence[str] = ()) -> DataFrame:
    """Map each decoded image to rows after its key; ``compute`` takes the pixels and the extra values."""
    columns = ["height", "width", "channels", "data", *extra]
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [[k, *row] for k, h, w, c, d, *more in zip(batch[key], *[batch[c] for c in columns])
                    for row in compute(to_bgr(d, h, w, c), *more)]
            yield pd.DataFrame(rows, columns=[key, *names])

    return images.select(key, *columns).mapInPandas(run, f"`{key}` string, {schema}")


def patch_angles(
    images: DataFrame, key: str = "path", patch: int = 32, margin: int = 10,
    dark_threshold: float = 18.0, min_valid: float = 0.95,
) -> DataFrame:
    """(key, patch_no, ita): median typology angle of up to eight patches per image, dark border avoided."""

    def compute(bgr: np.ndarray) -> list[tuple[int, float]]:
        return list(enumerate(edge_angles(bgr, patch, margin, dark_threshold, min_valid)))

    return _per_image(images, key, compute, "patch_no int, ita double")


def fenced_consensus(values: np.ndarray, fence: float = 1.5) -> tuple[float, float]:
    """(median, population spread) of the values inside the IQR fence; the same rule as ``realism.robust_consensus``."""
    q1, q3 = np.percentile(values, [25, 75])
    kept = values[(values >= q1 - fence * (q3 - q1)) & (values <= q3 + fence * (q3 - q1))]
    return float(np.median(kept)), float(kept.std())


def tone_by_angle(
    images: DataFrame, key: str = "path", max_spread: float = 15.0, ring: str | None = None,
    min_ring_pixels: int = 500, patch: int = 32, margin: int = 10, dark_threshold: float = 18.0, min_valid: float = 0.95,
) -> DataFrame:
    """(key, method, ita, ita_std, mst10_class, mst5_class, mst_name, confidence), each image decoded once.

    ``ring`` names a binary column with one byte for each pixel, not 0 inside the ring
    around a lesion. A ring of ``min_ring_pixels`` or more that fits the image gives the
    median angle of its pixels; otherwise, and without a ring, it is the consensus of
    the image's patches. Images without a usable angle keep a row with unknown classes.
    """

    def compute(bgr: np.ndarray, mask: bytes | None = None) -> list[tuple[str, float | None, float]]:
        inside = np.frombuffer(mask, np.uint8) != 0 if mask is not None else np.zeros(0, bool)
        if len(inside) == bgr.shape[0] * bgr.shape[1] and inside.sum() >= max(min_ring_pixels, 10):
            angles = angles_of(bgr).ravel()[inside]
            return [("perilesional_ring", float(np.median(angles)), float(angles.std()))]
        patches = edge_angles(bgr, patch, margin, dark_threshold, min_valid)
        return [("multi_patch", *(fenced_consensus(np.array(patches)) if patches else (None, 0.0)))]

    rows = _per_image(images, key, compute, "method string, ita double, std double", [ring] if ring else [])
    rows = rows.withColumn("ita", F.nanvl("ita", F.lit(None).cast("double")))
    mst5 = L.ita_to_mst5(F.col("ita"))
    return rows.select(
        key, "method", "ita", F.coalesce("std", F.lit(0.0)).alias("ita_std"),
        L.ita_to_mst10(F.col("ita")).alias("mst10_class"), mst5.alias("mst5_class"), L.mst5_name(mst5).alias("mst_name"),
        L.tier(F.coalesce("std", F.lit(0.0)), max_spread, high_if_below=True).alias("confidence"),
    )
