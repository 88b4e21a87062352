"""Files as DataFrames: photo trees, location histories (nested JSON, GPX) and embedded metadata."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.functions import exprs
from shutterlake.functions.exprs import EXTENSIONS

DUPLICATES_FOLDER = "_duplicates"


def photo_files(spark: SparkSession, root: str) -> DataFrame:
    """Photos below ``root``: id (relative path), path, filename, folder, size_kb, file_mtime, file_hash (MD5 of the first 64 KiB), content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").removeprefix("file://")
    path = F.regexp_replace(F.col("path"), "^file:/*", "/")
    rel = F.expr("substring(p, length(b) + 2)")
    out = files.withColumns({"p": path, "b": F.lit(base)}).withColumn("id", rel)
    parts = F.split("id", "/")
    ext = F.lower(F.regexp_extract("id", r"\.([^./]+)$", 1))
    out = out.where(ext.isin(*EXTENSIONS) & ~F.array_contains(parts, DUPLICATES_FOLDER))
    return out.select("id", F.col("p").alias("path"), F.element_at(parts, -1).alias("filename"), F.regexp_replace("id", "/?[^/]+$", "").alias("folder"), F.bround(F.col("length") / 1024).cast("long").alias("size_kb"), F.col("modificationTime").cast("double").alias("file_mtime"), F.md5(F.expr("substring(content, 1, 65536)")).alias("file_hash"), "content")


def takeout(spark: SparkSession, path: str) -> DataFrame:
    """us, lat, lon of a location history in JSON; records without coordinates or with an unreadable time are left out."""
    schema = "locations array<struct<timestamp:string,latitudeE7:bigint,longitudeE7:bigint>>"
    rows = spark.read.option("multiLine", True).schema(schema).json(path).select(F.inline("locations"))
    return _points(rows.where("latitudeE7 is not null and longitudeE7 is not null"), "timestamp", F.col("latitudeE7") / 1e7, F.col("longitudeE7") / 1e7)


def split_takeout(spark: SparkSession, path: str) -> DataFrame:
    """The same, with one file read by many tasks."""
    from . import takeout as pieces

    return _points(pieces.records(spark, path), "timestamp", F.col("lat"), F.col("lon"))


def gpx(spark: SparkSession, path: str) -> DataFrame:
    """us, lat, lon of the track points of GPX files, in any namespace."""
    rows = spark.read.format("xml").option("rowTag", "trkpt").option("ignoreNamespace", True).schema("_lat double, _lon double, time string").load(path)
    return _points(rows.where("_lat is not null and _lon is not null"), "time", F.col("_lat"), F.col("_lon"))


def _points(rows: DataFrame, time: str, lat, lon) -> DataFrame:
    return rows.select(F.unix_micros(exprs.iso_time(F.trim(time))).alias("us"), lat.alias("lat"), lon.alias("lon")).where("us is not null")


READERS = {".json": (split_takeout, "google_takeout"), ".gpx": (gpx, "gpx")}


def import_points(spark: SparkSession, path: str, import_id: int, target: str) -> str:
    """Appends a history file's points to the table at ``target``, partitioned by import; the kind of the source."""
    reader, kind = READERS[path[path.rfind(".") :].lower()]
    reader(spark, path).withColumn("import_id", F.lit(import_id).cast("long")).write.mode("append").partitionBy("import_id").parquet(target)
    return kind


# TIFF tags by number.
TAGS = {0x010E: "description", 0x010F: "make", 0x0110: "model", 0x0132: "date", 0x8769: "exif", 0x8825: "gps", 0x829A: "exposure", 0x829D: "fnumber", 0x8827: "iso", 0x9003: "original", 0x9004: "digitized", 0x920A: "focal", 0xA434: "lens"}
GPS_TAGS = {1: "lat_ref", 2: "lat", 3: "lon_ref", 4: "lon"}
#: Bytes of a value, by TIFF type.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}


def tiff_tags(data: bytes) -> dict[str, object]:
    """Tags of a TIFF block as text, numbers or lists of (numerator, denominator); what can't be read is left out."""
    found: dict[str, object] = {}
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8:
        return found

    def value(kind: int, count: int, at: int):
        size = SIZES.get(kind, 0) * count
        if not size:
            return None
        start = at if size <= 4 else struct.unpack_from(order + "I", data, at)[0]
        raw = data[start : start + size]
        if len(raw) < size:
            return None
        if kind in (2, 7):
            return raw.split(b"\0")[0].decode("utf-8", "replace").strip()
        if kind in (5, 10):
            n = struct.unpack(order + ("I" if kind == 5 else "i") * (2 * count), raw) if count == 1 else struct.unpack(f"{order}{2 * count}{'I' if kind == 5 else 'i'}", raw)
            return list(zip(n[::2], n[1::2], strict=True))
        return list(struct.unpack(f"{order}{count}{ {1: 'B', 3: 'H', 4: 'I', 9: 'i'}[kind] }", raw))

    def directory(at: int, names: dict[int, str], depth: int = 0) -> None:
        if depth > 3 or at + 2 > len(data):
            return
        (count,) = struct.unpack_from(order + "H", data, at)
        for k in range(count):
            place = at + 2 + 12 * k
            if place + 12 > len(data):
                return
            tag, kind, n = struct.unpack_from(order + "HHI", data, place)
            if (name := names.get(tag)) and (v := value(kind, n, place + 8)) is not None:
                if name in ("exif", "gps"):
                    directory(int(v[0]), GPS_TAGS if name == "gps" else TAGS, depth + 1)
                else:
                    found[name] = v

    directory(struct.unpack_from(order + "I", data, 4)[0], TAGS)
    return found


def tiff_block(content: bytes) -> bytes:
    """The TIFF block of a JPEG's EXIF segment, or the file itself if it is TIFF-like."""
    if content[:2] in (b"II", b"MM"):
        return content
    at = 2
    while content[:2] == b"\xff\xd8" and at + 4 <= len(content) and content[at] == 0xFF:
        marker, size = content[at + 1], struct.unpack_from(">H", content, at + 2)[0]
        if marker == 0xE1 and content[at + 4 : at + 10] == b"Exif\0\0":
            return content[at + 10 : at + 2 + size]
        if marker == 0xDA:
            break
        at += 2 + size
    return b""


_META = "id string, make string, model string, lens string, iso string, description string, original string, digitized string, date string, fnumber array<bigint>, exposure array<bigint>, focal array<bigint>, lat array<array<bigint>>, lat_ref string, lon array<array<bigint>>, lon_ref string"


def metadata(files: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """id, the raw tags of each file's ``content`` and the columns ``keep`` as they are; the rest is left to column expressions."""
    keep = list(keep)
    schema = ", ".join([_META, *(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in keep)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in _META.split(", ")]
        for batch in batches:
            rows = []
            for key, content in zip(batch["id"], batch["content"], strict=True):
                try:
                    tags = tiff_tags(tiff_block(bytes(content or b"")))
                except (struct.error, ValueError):
                    tags = {}
                one = lambda k: list(tags[k][0]) if isinstance(tags.get(k), list) and tags[k] and isinstance(tags[k][0], tuple) else None  # noqa: B023, E731
                text = lambda k: tags[k] if isinstance(tags.get(k), str) and tags[k] else None  # noqa: B023, E731
                three = lambda k: [list(p) for p in tags[k]] if isinstance(tags.get(k), list) and len(tags[k]) == 3 else None  # noqa: B023, E731
                iso = tags.get("iso")
                rows.append((key, text("make"), text("model"), text("lens"), str(iso[0]) if iso else None, text("description"), text("original"), text("digitized"), text("date"), one("fnumber"), one("exposure"), one("focal"), three("lat"), text("lat_ref"), three("lon"), text("lon_ref")))
            out = pd.DataFrame(rows, columns=names, index=batch.index).astype(object)
            yield out.assign(**{c: batch[c] for c in keep})

    return files.select("id", "content", *keep).mapInPandas(run, schema)


def described(tags: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Photo columns from raw tags, and the columns ``keep``."""
    ratio = lambda c, k: exprs.rational(F.col(c)[k][0], F.col(c)[k][1])
    degrees = lambda c: exprs.dms_to_decimal(ratio(c, 0), ratio(c, 1), ratio(c, 2), F.col(f"{c}_ref"))
    number = lambda c: exprs.rational(F.col(c)[0], F.col(c)[1])
    out = tags.withColumns({"_lat": degrees("lat"), "_lon": degrees("lon")})
    real = exprs.real_position(F.col("_lat"), F.col("_lon")) & F.col("_lat").isNotNull() & F.col("_lon").isNotNull()
    return out.select(
        "id",
        exprs.exif_date("original", "digitized", "date").alias("date_taken"),
        F.when(real, F.col("_lat")).alias("lat"),
        F.when(real, F.col("_lon")).alias("lon"),
        real.alias("has_gps"),
        F.when(~exprs.junk_description(F.col("description")), F.trim("description")).alias("location_name"),
        exprs.camera_name(F.col("make"), F.col("model")).alias("camera"),
        "lens",
        F.when(number("fnumber") != 0, exprs.aperture_text(number("fnumber"))).alias("aperture"),
        exprs.shutter_text(F.col("exposure")[0].cast("double"), F.col("exposure")[1].cast("double")).alias("shutter"),
        "iso",
        F.when(number("focal") != 0, exprs.focal_text(number("focal"))).alias("focal_length"),
        *keep,
    )
