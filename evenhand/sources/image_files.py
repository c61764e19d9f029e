"""Image files from array columns, and the border mask of images and arrays.

Files are made by the tasks that hold the rows: each is written under another name and
moved to its own when it is complete, so a task that runs twice leaves one whole file.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from evenhand.functions.masks import cleaned
from evenhand.sources.images import to_bgr


def png_bytes(bgr: np.ndarray) -> bytes:
    """A PNG of 8-bit colour without interlacing."""
    height, width = bgr.shape[:2]

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    lines = np.zeros((height, 1 + 3 * width), np.uint8)  # each line begins with filter 0
    lines[:, 1:] = bgr[:, :, ::-1].reshape(height, -1)
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def bmp_bytes(bgr: np.ndarray) -> bytes:
    """An uncompressed BMP of 24 bits a pixel: lines from the bottom, filled up to 4 bytes."""
    height, width = bgr.shape[:2]
    lines = np.zeros((height, -(-3 * width // 4) * 4), np.uint8)
    lines[:, :3 * width] = bgr[::-1].reshape(height, -1)
    data = lines.tobytes()
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + len(data), 0, 0, 54, 40, width, height, 1, 24, 0, len(data), 2835, 2835, 0, 0) + data


ENCODERS = {"png": png_bytes, "bmp": bmp_bytes}


def encoded_images(df: DataFrame, name: str, height: int, width: int, pixels: str, kind: str = "png") -> DataFrame:
    """(file, content): ``pixels`` is an array of height x width x 3 numbers, blue, green, red; values are cut to 0..255.

    A null array, one of another length or one that holds nulls gives a file
    that no reader can decode.
    """
    encode = ENCODERS[kind]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            contents = []
            for values in batch["pixels"]:
                flat = np.array(values if values is not None else [], np.float64)
                usable = len(flat) == height * width * 3 and np.isfinite(flat).all()
                contents.append(encode(np.clip(np.rint(flat), 0, 255).astype(np.uint8).reshape(height, width, 3)) if usable else b"no image")
            yield pd.DataFrame({"file": batch["file"], "content": contents})

    file = F.concat(F.col(name).cast("string"), F.lit(f".{kind}"))
    return df.select(file.alias("file"), F.col(pixels).cast("array<double>").alias("pixels")).mapInPandas(
        run, "file string, content binary")


def write_files(contents: DataFrame, folder: str) -> int:
    """Write each (file, content) row as a file below ``folder``; returns how many there were.

    ``folder`` is a path or a URI of a store that Arrow can write to. File names must be distinct.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        plain = folder.removeprefix("file:") if folder.startswith("file:/") and not folder.startswith("file://") else folder
        store, base = fs.FileSystem.from_uri(plain if "://" in plain else f"file://{plain}")
        store.create_dir(base, recursive=True)
        for batch in batches:
            for file, content in zip(batch["file"], batch["content"]):
                part = f"{base}/_{uuid.uuid4().hex}.tmp"  # names that begin so are not read
                with store.open_output_stream(part) as out:
                    out.write(content)
                store.move(part, f"{base}/{file}")
            yield pd.DataFrame({"n": [len(batch)]})

    return contents.select("file", "content").mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


# --- border mask --------------------------------------------------------------


def border_mask(images: DataFrame, key: str = "path", dark_threshold: float = 18.0, min_fraction: float = 0.02,
                size: int = 21) -> DataFrame:
    """(key, dark_fraction, border_fraction, has_border) of decoded images.

    Pixels brighter than ``dark_threshold`` are valid; specks narrower than a disc of
    ``size`` rows are removed, holes filled, and the largest component stays.
    ``border_fraction`` is the share of pixels outside of it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, h, w, c, d in zip(*(batch[n] for n in (key, "height", "width", "channels", "data"))):
                valid = np.rint(to_bgr(d, h, w, c) @ np.array([0.114, 0.587, 0.299])) > dark_threshold
                rows.append([k, float(1.0 - valid.mean()), float(1.0 - cleaned(valid, size).mean())])
            yield pd.DataFrame(rows, columns=[key, "dark_fraction", "border_fraction"])

    found = images.select(key, "height", "width", "channels", "data").mapInPandas(
        run, f"`{key}` string, dark_fraction double, border_fraction double")
    return found.withColumn("has_border", F.col("border_fraction") >= min_fraction)


def array_border(df: DataFrame, key: str, valid: Column, height: int, width: int, min_fraction: float = 0.02,
                 size: int = 21) -> DataFrame:
    """(key, border_fraction, has_border) of an array column of booleans, row by row of the image."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            shares = [float(1.0 - cleaned(np.array(m, bool).reshape(height, width), size).mean()) for m in batch["valid"]]
            yield pd.DataFrame({"key": batch["key"], "border_fraction": shares})

    rows = df.select(F.col(key).alias("key"), valid.alias("valid"))
    kind = rows.schema["key"].dataType.simpleString()
    found = rows.mapInPandas(run, f"key {kind}, border_fraction double").withColumnRenamed("key", key)
    return found.withColumn("has_border", F.col("border_fraction") >= min_fraction)
