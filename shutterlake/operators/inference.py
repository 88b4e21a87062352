"""Places for photos that have none: from the nearest photo in time, from a location history, from a lookup."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.functions import exprs

from . import temporal

#: points (id, lat, lon) -> (id, name): how places get their names.
Lookup = Callable[[DataFrame], DataFrame]


def gazetteer(places: DataFrame, cell: float = 1.0) -> Lookup:
    """A lookup in a table of places (lat, lon, name): the name of the cell that a point lies in, the first in order where it has several."""
    at = lambda c: F.floor(F.col(c) / cell)
    named = places.groupBy(at("lat").alias("_y"), at("lon").alias("_x")).agg(F.min("name").alias("name"))
    return lambda points: points.withColumns({"_y": at("lat"), "_x": at("lon")}).join(named, ["_y", "_x"]).select("id", "name")


def remote(call: Callable[[float, float], str | None], gap: float = 1.1) -> Lookup:
    """A lookup by a service that is asked in one task, with ``gap`` seconds between calls. Points are distinct already."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        free = 0.0
        for batch in batches:
            names = []
            for lat, lon in zip(batch["lat"], batch["lon"], strict=True):
                time.sleep(max(0.0, free - time.monotonic()))
                names.append(call(lat, lon))
                free = time.monotonic() + gap
            yield pd.DataFrame({"id": batch["id"], "name": names}).astype({"name": object})

    # one task on purpose: the gate is one for all calls
    return lambda points: points.select("id", "lat", "lon").repartition(1).mapInPandas(run, f"id {points.schema['id'].dataType.simpleString()}, name string").where("name is not null and name <> ''")


def targets(photos: DataFrame, pending: DataFrame, key: str = "id") -> DataFrame:
    """Photos to infer a place for: no position of their own, no pending coordinate, no name or match yet, a date."""
    staged = temporal.uncommitted(pending).where(F.col("field").isin("lat", "lon")).select(F.col("photo_id").alias(key)).distinct()
    open_ = ~F.col("has_gps") & ~F.coalesce(F.col("status"), F.lit("")).isin("named", "inferred", "history") & F.col("date_taken").isNotNull()
    return photos.where(open_).join(staged, key, "left_anti")


def inferred(photos: DataFrame, pending: DataFrame, lookup: Lookup, key: str = "id", order: str = "ord", minutes: int = 240) -> DataFrame:
    """``photos`` after a pass of inference, with inferred_lat, inferred_lon, inferred_from and inferred_delta_min.

    Sources are photos with a position, pending ones laid over. A neighbour
    without a name is looked up, each once however many photos it is nearest to.
    """
    names = [c for c in photos.columns if not c.startswith("inferred_")]
    open_ = targets(photos, pending, key).select(key, F.lit(True).alias("_open"))
    rows = temporal.effective_positions(photos.select(names), pending, key).join(open_, key, "left")
    source = F.col("has_gps") & F.col("lat").isNotNull() & F.col("lon").isNotNull()
    rows = rows.withColumns({"_source": source, "_open": F.coalesce("_open", F.lit(False)), "_key": F.col(key)})
    near = temporal.nearest_in_group(rows, "scan_root", "date_taken", order, "_source", "_open", minutes * temporal.MINUTE, ["lat", "lon", "filename", "_key", "location_name"])
    asked = near.where(exprs.blank(F.col("near_location_name"))).select(F.col("near__key").alias("id"), F.col("near_lat").alias("lat"), F.col("near_lon").alias("lon")).distinct()
    found = lookup(asked).select(F.col("id").alias("near__key"), F.col("name").alias("_name"))
    near = near.join(found, "near__key", "left")
    name = F.when(~exprs.blank(F.col("near_location_name")), F.col("near_location_name")).otherwise(F.col("_name"))
    got = near.select(key, F.struct(F.col("near_lat").alias("lat"), F.col("near_lon").alias("lon"), F.col("near_filename").alias("file"), exprs.minutes(F.col("near_us")).alias("min"), name.alias("name")).alias("_g"))
    hit = F.col("_g").isNotNull()
    own = {"status": F.when(hit, "inferred").otherwise(F.col("status")), "location_name": F.coalesce("_g.name", "location_name")}
    more = [F.col(f"_g.{a}").alias(f"inferred_{b}") for a, b in (("lat", "lat"), ("lon", "lon"), ("file", "from"), ("min", "delta_min"))]
    return photos.select(names).join(got, key, "left").select(*(own[c].alias(c) if c in own else c for c in names), *more)


def matched(photos: DataFrame, points: DataFrame, tolerance_min: int, key: str = "id") -> DataFrame:
    """``photos`` after a match against the history ``points`` (us, ord, lat, lon, import_id): history_lat, history_lon, history_delta_min, history_import_id, and the status; names stay."""
    names = [c for c in photos.columns if not c.startswith("history_")]
    asked = photos.where(~F.col("has_gps") & exprs.blank(F.col("location_name")) & F.col("date_taken").isNotNull())
    asked = asked.select(key, temporal.micros(F.date_trunc("second", F.col("date_taken").cast("timestamp"))).alias("us"))
    near = temporal.nearest_overall(asked, points, max(1, tolerance_min) * temporal.MINUTE, ["lat", "lon", "import_id"])
    got = near.select(key, F.col("near_lat").alias("history_lat"), F.col("near_lon").alias("history_lon"), exprs.minutes(F.col("near_us")).alias("history_delta_min"), F.col("near_import_id").alias("history_import_id"))
    out = photos.select(names).join(got, key, "left")
    return out.withColumn("status", F.when(F.col("history_delta_min").isNotNull(), "history").otherwise(F.col("status")))


def geocoded(photos: DataFrame, lookup: Lookup, key: str = "id") -> DataFrame:
    """``photos`` in which those with a position and no name have got one from the lookup, where it knows one; they count as gps then."""
    asked = photos.where(F.col("has_gps") & exprs.blank(F.col("location_name"))).select(F.col(key).alias("id"), "lat", "lon")
    found = lookup(asked).where(~exprs.blank(F.col("name"))).select(F.col("id").alias(key), F.col("name").alias("_name"))
    hit = F.col("_name").isNotNull()
    out = photos.join(found, key, "left").withColumns({"location_name": F.coalesce("_name", "location_name"), "status": F.when(hit, "gps").otherwise(F.col("status"))})
    return out.select(photos.columns)


def prompt(photos: DataFrame, neighbours: DataFrame, key: str = "id", most: int = 6) -> DataFrame:
    """``photos`` with prompt, what a text service is asked: date, folder and file, and the first neighbours (key, ord, filename, location_name, date_taken) with their places."""
    line = F.concat(F.lit("  - "), *(F.coalesce(F.col(c).cast("string"), F.lit("None")) if k == 0 else F.concat(F.lit(a), F.coalesce(F.col(c).cast("string"), F.lit("None")), F.lit(b)) for k, (c, a, b) in enumerate((("filename", "", ""), ("location_name", ": ", ""), ("date_taken", " (", ")")))))
    near = neighbours.select(key, F.struct("ord", line.alias("line")).alias("x")).groupBy(key).agg(F.slice(F.array_sort(F.collect_list("x")), 1, most).alias("_near"))
    said = lambda label, c: F.when(~exprs.blank(F.col(c).cast("string")), F.concat(F.lit(label), F.col(c).cast("string")))
    known = F.when(F.size("_near") > 0, F.concat(F.lit("\nNearby photos with known locations:\n"), F.array_join("_near.line", "\n")))
    out = photos.join(near, key, "left")
    return out.withColumn("prompt", F.concat_ws("\n", said("Photo taken: ", "date_taken"), said("Folder: ", "folder"), said("Filename: ", "filename"), known)).drop("_near")
