"""What users change: settings, sessions, staged and live saves, commits, discards, renames, moves, as functions over DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shutterlake.functions import exprs

from .scratch import Stored


def overwritten(rows: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """``rows`` with those of ``more`` in place of rows with their keys; of several in ``more`` the latest (updated_at) wins."""
    last = more.groupBy(key).agg(F.max_by(F.struct(*more.columns), "updated_at").alias("r")).select("r.*")
    return rows.join(last, key, "left_anti").select(rows.columns).unionByName(last.select(rows.columns))


def dry_run(value: Column, asked: Column) -> Column:
    """Whether writes are only staged: the setting (unset: yes) or the client says so."""
    return F.lower(F.coalesce(value, F.lit("true"))).isin("1", "true", "yes") | F.coalesce(asked, F.lit(False))


def is_dry_run(settings: DataFrame, asked: bool = False) -> bool:
    """For sinks: a client can only make it stricter than the setting."""
    row = settings.where("key = 'dry_run'").select(dry_run(F.col("value"), F.lit(asked)).alias("d")).first()
    return True if row is None else bool(row["d"])


def gated(settings: DataFrame, asked: bool, live: Callable[[], object], stage: Callable[[], object]) -> object:
    """Runs ``stage`` where writes are only staged, else ``live``."""
    return stage() if is_dry_run(settings, asked) else live()


#: Fields that a save stages, and those that have no column of the photo's own.
SAVED, ACTIONS = ("location_name", "lat", "lon", "date_taken"), ("rotate_degrees",)


def staged_saves(edits: DataFrame, photos: DataFrame, key: str = "id") -> DataFrame:
    """Changes (photo_id, field, old_value, new_value) of saves on known photos: one for each field with a value; a turn by nought is none."""
    fields = [f for f in (*SAVED, *ACTIONS) if f in edits.columns]
    new = lambda f: F.nullif(F.col(f"e.{f}"), F.lit(0)) if f in ACTIONS else F.col(f"e.{f}")
    old = lambda f: F.col(f"p.{f}").cast("string") if f in photos.columns and f not in ACTIONS else F.lit(None).cast("string")
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), old(f).alias("old_value"), new(f).cast("string").alias("new_value")) for f in fields))
    both = edits.alias("e").join(photos.alias("p"), F.col(f"e.{key}") == F.col(f"p.{key}"))
    return both.select(F.col(f"e.{key}").alias("photo_id"), F.inline(pairs)).where("new_value is not null")


def saved(photos: DataFrame, edits: DataFrame, key: str = "id", batch: bool = False) -> DataFrame:
    """``photos`` after live saves: name, position, status, and the date, which saves in a batch leave alone."""
    set_ = [c for c in ("location_name", "lat", "lon", "date_taken") if c in edits.columns and not (batch and c == "date_taken")]
    e = edits.select(F.col(key), F.struct(*set_).alias("_e"))
    hit = F.col("_e").isNotNull()
    place = {"status": exprs.saved_status(F.col("_e.lat"), F.col("_e.lon"), F.col("_e.location_name")), "has_gps": F.coalesce((F.col("_e.lat") != 0) & (F.col("_e.lon") != 0), F.lit(False))}
    values = {c: F.col(f"_e.{c}") for c in set_} | place
    return photos.join(e, key, "left").select(*(F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else c for c in photos.columns))


def discarded(changes: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """``changes`` without those whose id is in ``ids``, committed or not; without ``ids`` all uncommitted ones go."""
    return changes.where("committed") if ids is None else changes.join(ids.select("id").distinct(), "id", "left_anti").select(changes.columns)


def listed(changes: DataFrame, photos: DataFrame, key: str = "id") -> DataFrame:
    """Uncommitted changes by photo: photo_id, filename, and changes, an array of (field, id, old_value, new_value) in the order of fields."""
    rows = changes.where("not committed").join(photos.select(F.col(key).alias("photo_id"), "filename"), "photo_id")
    one = F.struct("field", "id", "old_value", "new_value")
    return rows.groupBy("photo_id", "filename").agg(F.array_sort(F.collect_list(one)).alias("changes"))


def commit_rows(changes: DataFrame, photos: DataFrame, ids: list[int] | None = None, key: str = "id") -> DataFrame:
    """Uncommitted changes of known photos with the photo's path, only those of ``ids`` if there are any."""
    rows = changes.where("not committed")
    rows = rows.where(F.col("id").isin(*ids)) if ids else rows
    return rows.join(photos.select(F.col(key).alias("photo_id"), "path"), "photo_id")


def committed(changes: DataFrame, results: DataFrame) -> DataFrame:
    """``changes`` in which all uncommitted rows of photos that went well (photo_id, ok) count as committed."""
    done = results.where("ok").select("photo_id", F.lit(True).alias("_done")).distinct()
    return changes.join(done, "photo_id", "left").withColumn("committed", F.col("committed") | F.coalesce("_done", F.lit(False))).select(changes.columns)


def commit_count(results: DataFrame) -> DataFrame:
    return results.agg(F.count_if("ok").alias("committed"))


def move_plan(files: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """``files`` (folder, filename, ord) with target, the name each gets in the folder for duplicates, and sidecar_target.

    The first of one name keeps it unless it is ``taken`` (folder, filename);
    others get " (n)" with the next number that neither a taken name nor the name
    of another file to move has, so no two targets are the same.
    """
    stem, ext = exprs.stem(F.col("filename")), exprs.suffix(F.col("filename"))
    held = files.select("folder", "filename") if taken is None else files.select("folder", "filename").union(taken.select("folder", "filename"))
    pattern = r"^(.+) \(([1-9][0-9]{0,8})\)(\.[^./]+)?$"
    part = lambda k: F.regexp_extract("filename", pattern, k)
    used = held.where(F.col("filename").rlike(pattern)).groupBy("folder", F.concat(part(1), part(3)).alias("_base")).agg(F.sort_array(F.collect_set(part(2).cast("long"))).alias("_used"))
    gone = files.limit(0).select("folder", "filename") if taken is None else taken.select("folder", "filename").distinct()
    rows = files.join(gone.withColumn("_taken", F.lit(1)), ["folder", "filename"], "left")
    rank = F.row_number().over(Window.partitionBy("folder", "filename").orderBy("ord")) - 1 + F.coalesce("_taken", F.lit(0))
    rows = rows.withColumns({"_r": rank.cast("long"), "_base": F.concat(stem, ext)}).join(used, ["folder", "_base"], "left")
    number = F.expr("aggregate(coalesce(_used, array()), _r, (n, x) -> if(x <= n and x > 0, n + 1, n))")
    target = F.when(F.col("_r") == 0, F.col("filename")).otherwise(F.concat(stem, F.lit(" ("), number.cast("string"), F.lit(")"), ext))
    return rows.withColumn("target", target).withColumn("sidecar_target", F.concat(exprs.stem(F.col("target")), F.lit(".xmp"))).select(*files.columns, "target", "sidecar_target")


def moved(photos: DataFrame, changes: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Photos and changes after the photos in ``ids`` have left the library."""
    gone = Stored(ids.select("id").distinct(), "moved").df
    return photos.join(gone, "id", "left_anti").select(photos.columns), changes.join(gone.withColumnRenamed("id", "photo_id"), "photo_id", "left_anti").select(changes.columns)


def sessions_after(sessions: DataFrame, new: DataFrame, used: DataFrame, gone: DataFrame) -> DataFrame:
    """``sessions`` (id, name, scan_root, last_used) with those added that have a name and a folder, used ones (id, at) touched, and deleted ones (id) left out; last used first."""
    trimmed = new.withColumns({"name": F.trim("name"), "scan_root": F.trim("scan_root")}).where("name <> '' and scan_root <> ''")
    rows = sessions.unionByName(trimmed.select(sessions.columns))
    last = used.groupBy("id").agg(F.max("at").alias("_at"))
    rows = rows.join(last, "id", "left").withColumn("last_used", F.coalesce("_at", "last_used")).select(sessions.columns)
    return rows.join(gone.select("id"), "id", "left_anti").orderBy(F.desc_nulls_last("last_used"), "id")
