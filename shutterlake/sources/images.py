"""Pictures: decoded by Spark's image source, hashed and scaled with numpy on the executors.

Decoded pictures are large: bound ``spark.sql.execution.arrow.maxBytesPerBatch``
where many of them meet in a task.
"""

from __future__ import annotations

import base64
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .encode import jpeg


def pictures(spark: SparkSession, root: str) -> DataFrame:
    """path, height, width, channels and data (rows of blue, green, red) of all files below ``root``; data is null where a file is no picture that can be decoded."""
    rows = spark.read.format("image").option("recursiveFileLookup", True).option("dropInvalid", False).load(root).select("image.*")
    good = (F.col("height") > 0) & (F.col("width") > 0)
    return rows.select(F.regexp_replace("origin", "^file:/*", "/").alias("path"), "height", "width", F.col("nChannels").alias("channels"), F.when(good, F.col("data")).alias("data"))


def pixels(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """Height x width x 3, red first."""
    raw = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(raw, 3, axis=2) if channels == 1 else raw[:, :, 2::-1]


def grey(rgb: np.ndarray) -> np.ndarray:
    return rgb @ np.array([0.299, 0.587, 0.114])


def _weights(size: int, to: int) -> np.ndarray:
    """to x size: the share of each pixel in the cells of a coarser grid; nearest pixels where the grid is finer."""
    edges = np.linspace(0, size, to + 1)
    low, high = np.arange(size), np.arange(1, size + 1)
    share = np.clip(np.minimum(high, edges[1:, None]) - np.maximum(low, edges[:-1, None]), 0, None)
    return share / share.sum(1, keepdims=True)


def scaled(plane: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the area that each new pixel covers."""
    return _weights(plane.shape[0], height) @ plane @ _weights(plane.shape[1], width).T


def _hex(bits: np.ndarray) -> str:
    return np.packbits(bits.reshape(-1)).tobytes().hex()


def perceptual_hash(plane: np.ndarray) -> str:
    """64 bits: which of the 8 x 8 lowest cosine frequencies of the picture at 32 x 32 pass their median."""
    n = np.arange(32)
    cosines = np.cos(np.pi / 32 * (n[None, :] + 0.5) * n[:8, None])
    low = cosines @ scaled(plane, 32, 32) @ cosines.T
    return _hex(low > np.median(low))


def gradient_hash(plane: np.ndarray) -> str:
    """64 bits: whether the picture at 9 x 8 grows lighter from each pixel to the one on its right."""
    small = scaled(plane, 8, 9)
    return _hex(small[:, 1:] > small[:, :-1])


def hashes(images: DataFrame) -> DataFrame:
    """path, phash and dhash (hex; null for what can't be decoded)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, h, w, c, data in zip(*(batch[k] for k in ("path", "height", "width", "channels", "data")), strict=True):
                plane = grey(pixels(h, w, c, data)) if data is not None else None
                rows.append((path, *((None, None) if plane is None else (perceptual_hash(plane), gradient_hash(plane)))))
            yield pd.DataFrame(rows, columns=["path", "phash", "dhash"]).astype(object)

    return images.mapInPandas(run, "path string, phash string, dhash string")


def levels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """path, height, width and the least and largest value of each picture of ``pictures``; nulls where it can't be decoded."""
    for batch in batches:
        raw = [None if data is None else np.frombuffer(data, np.uint8) for data in batch["data"]]
        least, most = ([None if x is None else int(f(x)) for x in raw] for f in (np.min, np.max))
        yield batch[["path", "height", "width"]].assign(darkest=pd.array(least, "Int64"), lightest=pd.array(most, "Int64"))


def png(rgb: np.ndarray) -> bytes:
    """A PNG file, eight bits a channel."""
    h, w, _ = rgb.shape
    rows = b"".join(b"\0" + r.tobytes() for r in np.ascontiguousarray(rgb, np.uint8))
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def smaller(rgb: np.ndarray, longest: int) -> np.ndarray:
    """The picture with a longer side of at most ``longest`` pixels; small ones keep their size."""
    h, w, _ = rgb.shape
    share = min(1.0, longest / max(h, w))
    if share == 1:
        return rgb
    to = max(1, round(h * share)), max(1, round(w * share))
    return np.stack([np.rint(scaled(rgb[:, :, k].astype(float), *to)) for k in range(3)], axis=2).astype(np.uint8)


def thumbnails(images: DataFrame, longest: int = 400, quality: int = 75) -> DataFrame:
    """path and thumbnail: a JPEG in base64 whose longer side has at most ``longest`` pixels; null for what can't be decoded. Small pictures keep their size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, h, w, c, data in zip(*(batch[k] for k in ("path", "height", "width", "channels", "data")), strict=True):
                text = None
                if data is not None:
                    text = base64.b64encode(jpeg(smaller(pixels(h, w, c, data), longest), quality)).decode()
                rows.append((path, text))
            yield pd.DataFrame(rows, columns=["path", "thumbnail"]).astype(object)

    return images.mapInPandas(run, "path string, thumbnail string")


def photos_with_hashes(files: DataFrame, images: DataFrame) -> DataFrame:
    """``files`` (path, ...) with phash and dhash."""
    return files.join(hashes(images), "path", "left")
