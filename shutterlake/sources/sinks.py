"""What is written for a photo, as columns, and sinks that write it where the dry-run setting allows."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from shutterlake.functions import exprs
from shutterlake.operators import edits, library
from shutterlake.operators.scratch import stored

from . import jpeg


def writer(filename: Column) -> Column:
    """Which writer a file takes: exif for JPEG files, a sidecar for all others."""
    return F.when(F.lower(exprs.suffix(filename)).isin(".jpg", ".jpeg"), "exif").otherwise("sidecar")


def as_json(rows: DataFrame, column: str = "json") -> DataFrame:
    """Each row as a JSON object; nulls are written."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias(column))


def jpeg_payload(photos: DataFrame) -> DataFrame:
    """``photos`` with the tags that a JPEG file gets: description, both coordinates as degrees/1,minutes/1,hundredths/100 with their references, and the date. Null where there is nothing to write; a place needs both coordinates."""
    both = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    out = {"tag_description": F.when(~exprs.blank(F.col("location_name")), F.col("location_name"))}
    for c, north, south in (("lat", "N", "S"), ("lon", "E", "W")):
        parts = exprs.decimal_to_dms(F.col(c), north, south)
        text = F.concat(parts["deg"].cast("string"), F.lit("/1,"), parts["min"].cast("string"), F.lit("/1,"), parts["sec100"].cast("string"), F.lit("/100"))
        out |= {f"tag_{c}": F.when(both, text), f"tag_{c}_ref": F.when(both, parts["ref"])}
    out["tag_date"] = F.date_format("date_taken", "yyyy:MM:dd HH:mm:ss")
    return photos.withColumns(out)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path (a URI of a store that pyarrow knows, or a plain path) and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def exists(path: str) -> bool:
    store, at = opened(path)
    return store.get_file_info(at).type == fs.FileType.File


def content(path: str) -> bytes:
    store, at = opened(path)
    with store.open_input_stream(at) as f:
        return f.read()


def put(path: str, data: bytes) -> None:
    """Written beside and moved, so that a task that is lost or runs again leaves a whole file."""
    store, at = opened(path)
    with store.open_output_stream(f"{at}.part") as f:
        f.write(data)
    store.move(f"{at}.part", at)


def write_sidecars(photos: DataFrame, settings: DataFrame, asked: bool = False) -> DataFrame | None:
    """Writes the sidecar of each photo that takes one beside its path (a place that all machines see); with the dry-run setting nothing is written and what would be is returned."""
    rows = library.sidecar(photos.where(writer(F.col("filename")) == "sidecar")).select(F.concat(exprs.stem(F.col("path")), F.lit(".xmp")).alias("path"), "xmp")

    def write(part: Iterator[Row]) -> None:
        for row in part:
            put(row["path"], row["xmp"].encode())

    return edits.gated(settings, asked, lambda: rows.foreachPartition(write), lambda: rows)


def write_tags(photos: DataFrame, settings: DataFrame, asked: bool = False) -> DataFrame:
    """Writes place and date into the JPEG files among ``photos`` (path, filename, location_name, lat, lon, date_taken): path, ok and error of each.

    A file that is gone or can't be read through stays as it is and gives an error.
    Writing twice gives the same tags, so a task may run again. With the
    dry-run setting nothing is read or written, and the payload is returned.
    """
    rows = jpeg_payload(photos.where(writer(F.col("filename")) == "exif")).select("path", *jpeg.PAYLOAD)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            error = []
            for path, *tags in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    put(path, jpeg.tagged(content(path), *tags))
                    error.append(None)
                except (OSError, ValueError, struct.error) as e:
                    error.append(f"{path}: {e}")
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array([e is None for e in error]), pa.array(error, pa.string())], names=["path", "ok", "error"])

    # stored: what is returned must not write once more each time that it is read
    return edits.gated(settings, asked, lambda: stored(rows.mapInArrow(write, "path string, ok boolean, error string"), "tags_written"), lambda: rows)
