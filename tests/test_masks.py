"""Clean-up of masks against pixel-by-pixel definitions, and image files there and back."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenhand.functions.masks import cleaned, closed, disc, grow, largest_component, opened, run_components, shrink
from evenhand.sources import image_files, images


def plain_grow(mask, size):
    r, found = size // 2, np.zeros(mask.shape, bool)
    for y, x in zip(*np.nonzero(mask)):
        for dy, half in zip(range(-r, r + 1), disc(size)):
            for dx in range(-half, half + 1):
                if 0 <= y + dy < len(mask) and 0 <= x + dx < mask.shape[1]:
                    found[y + dy, x + dx] = True
    return found


def flood(mask):
    """Component number of each pixel, in the order of their first pixels, 0 for unset ones."""
    name, n = np.zeros(mask.shape, int), 0
    for y, x in zip(*np.nonzero(mask)):
        if name[y, x]:
            continue
        n += 1
        open_ = [(y, x)]
        while open_:
            a, b = open_.pop()
            if 0 <= a < len(mask) and 0 <= b < mask.shape[1] and mask[a, b] and not name[a, b]:
                name[a, b] = n
                open_ += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    return name


@pytest.mark.parametrize("seed", range(12))
def test_runs_equal_pixels(seed):
    rng = np.random.default_rng(seed)
    mask = rng.random(rng.integers(1, 40, 2)) < rng.choice([0.1, 0.4, 0.6, 0.9])
    for size in (1, 3, 5, 7):
        assert (grow(mask, size) == plain_grow(mask, size)).all()
        assert (shrink(mask, size) == ~plain_grow(~mask, size)).all()
        assert (opened(mask, size) <= mask).all() and (closed(mask, size) >= mask).all()
    name = flood(mask)
    row, start, end, found = run_components(mask)
    assert sum(end - start) == mask.sum()
    for r, a, z, f in zip(row, start, end, found):
        assert (name[r, a:z] == name[row[f], start[f]]).all()
    assert len(set(found.tolist())) == name.max()
    if mask.any():
        assert (largest_component(mask) == (name == 1 + np.bincount(name[name > 0] - 1).argmax())).all()


def test_specks_holes_and_border():
    assert disc(3) == (0, 1, 0) and disc(5) == (0, 2, 2, 2, 0) and len(disc(21)) == 21
    valid = np.zeros((80, 80), bool)
    valid[10:70, 10:70] = True
    valid[30:33, 30:33] = False  # a dark speck inside, to be filled
    valid[2:5, 2:5] = True  # a bright speck in the border, to be removed
    got = cleaned(valid, 11)
    assert got[31, 31] and not got[3, 3] and 0.5 < got.mean() < 0.5625
    assert not cleaned(np.zeros((5, 7), bool)).any() and cleaned(np.ones((5, 7), bool)).all()


@pytest.mark.parametrize("kind", ["png", "bmp"])
def test_files_there_and_back(spark, tmp_path, kind):
    rng = np.random.default_rng(3)
    pixels = {f"i{n}": rng.integers(0, 256, (5, 7, 3)) for n in range(9)}
    rows = [(n, v.ravel().astype(float).tolist()) for n, v in pixels.items()]
    table = spark.createDataFrame(rows + [("none", None), ("short", [1.0])], "name string, p array<double>").repartition(3)
    written = image_files.write_files(image_files.encoded_images(table, "name", 5, 7, "p", kind), str(tmp_path))
    assert written == 11 and len(list(tmp_path.iterdir())) == 11
    again = image_files.write_files(image_files.encoded_images(table, "name", 5, 7, "p", kind), f"file:{tmp_path}")
    assert again == 11 and len(list(tmp_path.iterdir())) == 11
    read = {r["path"].rsplit("/", 1)[1]: r for r in images.read_images(spark, str(tmp_path)).collect()}
    assert sorted(read) == sorted(f"{n}.{kind}" for n in pixels)
    for n, v in pixels.items():
        r = read[f"{n}.{kind}"]
        assert (images.to_bgr(r["data"], r["height"], r["width"], r["channels"]) == v).all()
    assert images.read_images(spark, str(tmp_path), on_error="placeholder").count() == 11


def test_border_of_images_and_arrays(spark, tmp_path):
    valid = np.zeros((40, 40), bool)
    valid[8:36, 4:38] = True
    bgr = np.repeat(np.where(valid, 200, 3)[:, :, None], 3, axis=2)
    table = spark.createDataFrame([("a", bgr.ravel().astype(float).tolist())], "name string, p array<double>")
    image_files.write_files(image_files.encoded_images(table, "name", 40, 40, "p"), str(tmp_path))
    want = 1 - cleaned(valid, 7).mean()
    got = image_files.border_mask(images.read_images(spark, str(tmp_path)), size=7).first()
    assert got["border_fraction"] == pytest.approx(want) and got["has_border"] and got["dark_fraction"] == pytest.approx(1 - valid.mean())
    one = image_files.array_border(table, "name", F.transform(F.filter("p", lambda x, i: i % 3 == 0), lambda x: x > 18), 40, 40, size=7).first()
    assert one["border_fraction"] == pytest.approx(want)
