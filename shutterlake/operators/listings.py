"""Ordered and filtered views of the library. Orders are total (ties by id), nulls stand where SQLite has them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Name of an order -> how its column goes, and that column; ties go by rising id.
ORDERS = {
    "paths": (F.asc_nulls_first, "path"),
    "date_taken": (F.asc_nulls_first, "date_taken"),
    "name": (F.asc_nulls_first, "name"),
    "name_desc": (F.desc_nulls_last, "name"),
    "recent": (F.desc_nulls_last, "last_used"),
    "newest": (F.desc_nulls_last, "created_at"),
    "oldest": (F.asc_nulls_first, "created_at"),
    "imports": (F.desc_nulls_last, "imported_at"),
    "points": (F.asc_nulls_first, "timestamp_epoch"),
}


def ordered(rows: DataFrame, order: str, limit: int | None = None) -> DataFrame:
    """``rows`` in one of ``ORDERS``; with ``limit`` the first of them."""
    side, column = ORDERS[order]
    out = rows.orderBy(side(column), F.asc_nulls_first("id"))
    return out if limit is None else out.limit(limit)


def custom(rows: DataFrame, places: DataFrame) -> DataFrame:
    """``rows`` in an order given by hand (id, place); those without a place come last."""
    return rows.join(places.select("id", F.col("place").alias("_place")), "id", "left").orderBy(F.asc_nulls_last("_place"), "id").drop("_place")


def search(photos: DataFrame, text: str = "", status: str | None = None) -> DataFrame:
    """Photos whose file name, folder or place holds ``text`` in any case, of one status if that is given."""
    low = F.lit(text.lower())
    hit = F.lit(False)
    for c in ("filename", "folder", "location_name"):
        hit = hit | F.coalesce(F.contains(F.lower(c), low), F.lit(False))
    return photos.where(hit if status is None else hit & (F.col("status") == status))


def by_ids(rows: DataFrame, ids: list, column: str = "id") -> DataFrame:
    return rows.where(F.col(column).isin(*ids))


def found_places(places: DataFrame, text: str, limit: int = 5) -> DataFrame:
    """Places (name, lat, lon) that hold the text, the shortest names first."""
    return places.where(F.contains(F.lower("name"), F.lit(text.lower()))).orderBy(F.length("name"), "name", "lat", "lon").limit(limit)


def subfolders(folders: DataFrame, parent: str) -> DataFrame:
    """Names of the folders right below ``parent`` among ``folders`` (path), without hidden ones, in order, each with its parent."""
    base = parent.rstrip("/") + "/"
    name = F.split(F.substring(F.col("path"), F.lit(len(base) + 1), F.length("path")), "/")[0]
    rows = folders.where(F.startswith(F.col("path"), F.lit(base))).select(name.alias("name")).where("name <> '' and not startswith(name, '.')")
    return rows.distinct().orderBy("name").withColumn("parent", F.lit(parent.rstrip("/") or "/"))
