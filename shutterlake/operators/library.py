"""The photo library as pure functions over DataFrames: upserts, rescans, changes, renames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shutterlake.functions import exprs

from .ranking import numbered

#: Fixed value: the sidecar's text.
SIDECAR = """<?xpacket begin='' id='W5M0MpCehiHzreSzNTczkc9d'?>
<x:xmpmeta xmlns:x='adobe:ns:meta/'>
  <rdf:RDF xmlns:rdf='http://www.w3.org/1999/02/22-rdf-syntax-ns#'>
    <rdf:Description rdf:about=''
      xmlns:dc='http://purl.org/dc/elements/1.1/'
      xmlns:exif='http://ns.adobe.com/exif/1.0/'
      xmlns:xmp='http://ns.adobe.com/xap/1.0/'>
      <dc:description><rdf:Alt><rdf:li xml:lang='x-default'>%s</rdf:li></rdf:Alt></dc:description>
      <exif:GPSLatitude>%s</exif:GPSLatitude>
      <exif:GPSLongitude>%s</exif:GPSLongitude>
      <xmp:CreateDate>%s</xmp:CreateDate>
    </rdf:Description>
  </rdf:RDF>
</x:xmpmeta>
<?xpacket end='w'?>"""


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Scan results merged into the library: location_name and status by their rules, other scan columns from the new row, columns that scans don't have from the old one."""
    o, n = old.alias("o"), new.alias("n")
    there, fresh = F.col(f"o.{key}").isNotNull(), F.col(f"n.{key}").isNotNull()
    junk = exprs.junk_description(F.col("o.location_name"))
    name = F.coalesce(F.col("n.location_name"), F.when(there & ~junk, F.col("o.location_name")))
    keep = F.col("o.status").isin("named", "gps", "history") & (F.col("n.status") == "unknown") & ~((F.col("o.status") == "named") & junk)
    status = F.when(there & keep, F.col("o.status")).otherwise(F.col("n.status"))
    merged = {"location_name": F.when(fresh, name).otherwise(F.col("o.location_name")), "status": F.when(fresh, status).otherwise(F.col("o.status"))}
    columns = list(dict.fromkeys([*old.columns, *new.columns]))
    pick = lambda c: F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) if c in old.columns and c in new.columns else F.col(f"n.{c}" if c in new.columns else f"o.{c}")
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer").select(*(F.coalesce(f"n.{key}", f"o.{key}").alias(c) if c == key else merged.get(c, pick(c)).alias(c) for c in columns))


def to_rescan(files: DataFrame, library: DataFrame, key: str = "id", mtime: str = "file_mtime") -> DataFrame:
    """Files that the library lacks or whose time differs by over a second; an unknown time counts as nought."""
    known = library.select(key, F.coalesce(mtime, F.lit(0.0)).alias("_known"))
    return files.join(known, key, "left").where(F.col("_known").isNull() | (F.abs(F.col(mtime) - F.col("_known")) > 1)).drop("_known")


def latest_pending(changes: DataFrame) -> DataFrame:
    """The newest uncommitted change of each photo and field."""
    rows = changes.where(~F.col("committed"))
    last = rows.groupBy("photo_id", "field").agg(F.max("id").alias("id"))
    return rows.join(last, ["photo_id", "field", "id"], "left_semi")


def staged(changes: DataFrame, more: DataFrame) -> DataFrame:
    """``changes`` with ``more`` staged on top: they supersede uncommitted rows of their photo and field."""
    again = more.select("photo_id", "field").distinct().withColumn("_new", F.lit(True))
    kept = changes.join(again, ["photo_id", "field"], "left").where(F.col("committed") | F.col("_new").isNull()).drop("_new")
    return kept.unionByName(more)


def wide_to_changes(edits: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row for each field that has a value: photo_id, field, new_value as text."""
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("new_value")) for f in fields))
    return edits.select(F.col(key).alias("photo_id"), F.inline(pairs)).where("new_value is not null")


FIELDS = ("location_name", "lat", "lon", "date_taken", "rotate_degrees", "rename", "move_to_duplicates")


def pivoted(changes: DataFrame) -> DataFrame:
    """One row for each photo with a column for each field; later rows win."""
    at = lambda f: F.max_by(F.when(F.col("field") == f, F.col("new_value")), F.when(F.col("field") == f, F.col("id")))
    return changes.groupBy("photo_id").agg(*(at(f).alias(f) for f in FIELDS))


def commit_plan(changes: DataFrame) -> DataFrame:
    """What to do for each photo, in this order: move (and nothing else), write, rotate, rename."""
    full = lambda c: ~exprs.blank(F.col(c))
    move = full("move_to_duplicates")
    some = full("location_name") | full("lat") | full("lon") | full("date_taken")
    return pivoted(changes).select("photo_id", move.alias("move"), (~move & some).alias("write"), (~move & full("rotate_degrees")).alias("rotate"), (~move & full("rename")).alias("rename"))


def without_import(photos: DataFrame, points: DataFrame, import_id: int) -> tuple[DataFrame, DataFrame]:
    """Photos and points after an import is deleted."""
    hit = F.coalesce(F.col("history_import_id") == import_id, F.lit(False))
    gone = ("history_lat", "history_lon", "history_delta_min", "history_import_id")
    changed = {c: F.when(~hit, F.col(c)) for c in gone if c in photos.columns}
    status = F.when(hit & (F.col("status") == "history"), "unknown").otherwise(F.col("status"))
    return photos.withColumns({**changed, "status": status}), points.where(~F.coalesce(F.col("import_id") == import_id, F.lit(False)))


def rename_preview(photos: DataFrame, pattern: str, order: str) -> DataFrame:
    """``photos`` with new_name: numbered from 1 for each day in the order of the numeric column given. A day with most of the photos is numbered in parts."""
    day = F.coalesce(F.date_format("date_taken", "yyyy-MM-dd"), F.lit("nodate"))
    ext, stem = exprs.suffix(F.col("filename")), exprs.stem(F.col("filename"))
    tokens = {"date": F.col("_day"), "time": F.coalesce(F.date_format("date_taken", "HHmmss"), F.lit("")), "location": exprs.slug(F.coalesce("location_name", F.lit(""))), "seq": F.format_string("%03d", "_seq"), "orig": stem, "ext": ext}
    name = exprs.renamed(F.lit(pattern), tokens, ext)
    rows = numbered(photos.withColumn("_day", day), ["_day"], order, "_seq")
    return rows.withColumn("new_name", F.when(name != "", name).otherwise(F.concat(stem, ext))).select(*photos.columns, "new_name")


def rename_plan(renames: DataFrame) -> DataFrame:
    """``renames`` (folder, filename, new_name) with valid and collision (another row of the folder has or gets that name)."""
    valid = ~exprs.blank(F.col("new_name")) & ~F.col("new_name").rlike(r"[/\\]")
    taken = renames.select("folder", F.col("filename").alias("new_name")).union(renames.where("filename <> new_name").select("folder", "new_name")).groupBy("folder", "new_name").count()
    return renames.join(taken, ["folder", "new_name"], "left").withColumns({"valid": valid, "collision": (F.col("filename") != F.col("new_name")) & (F.col("count") > 1)}).drop("count")


def sidecar(photos: DataFrame) -> DataFrame:
    """``photos`` with xmp, the text of each one's sidecar file."""
    def place(c: str, north: str, south: str):
        v = F.col(c)
        return F.coalesce(F.concat(F.format_string("%.6f", F.abs(v)), F.when(v >= 0, north).otherwise(south)), F.lit(""))

    text = lambda c: F.coalesce(exprs.xml_text(F.col(c).cast("string")), F.lit(""))
    lat, lon = (F.when(F.col(c).isNotNull(), place(c, *h)).otherwise("") for c, h in (("lat", "NS"), ("lon", "EW")))
    return photos.withColumn("xmp", F.format_string(SIDECAR, text("location_name"), lat, lon, text("date_taken")))


def frequent_places(photos: DataFrame, limit: int = 8) -> DataFrame:
    rows = photos.where(~exprs.blank(F.col("location_name")) & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    found = rows.groupBy("location_name").agg(F.count("*").alias("n"), F.round(F.avg("lat"), 6).alias("avg_lat"), F.round(F.avg("lon"), 6).alias("avg_lon"))
    return found.orderBy(F.desc("n"), "location_name").limit(limit)


def daily_quota(calls: DataFrame, day: str, limit: int) -> DataFrame:
    return calls.groupBy(F.to_date(day).alias("day")).agg(F.count("*").alias("used")).withColumn("remaining", F.greatest(F.lit(0), F.lit(limit) - F.col("used")))


def saved_places(places: DataFrame, limit: int = 50) -> DataFrame:
    """Newest first, each name once."""
    return places.groupBy("name").agg(F.max("ord").alias("ord")).orderBy(F.desc("ord"), "name").limit(limit)


def propagation_targets(photos: DataFrame) -> DataFrame:
    """Photos of folders in which some photo has a place; those of unknown status are selected beforehand."""
    named = photos.where(~exprs.blank(F.col("location_name"))).select("scan_root", "folder").distinct()
    out = photos.join(named, ["scan_root", "folder"], "left_semi").where(exprs.blank(F.col("location_name")))
    return out.withColumn("selected", F.col("status") == "unknown")


def date_targets(photos: DataFrame) -> DataFrame:
    """Photos with a file system's date in folders in which some photo has one of its own."""
    dated = photos.where("date_source = 'exif'").select("scan_root", "folder").distinct()
    return photos.join(dated, ["scan_root", "folder"], "left_semi").where("date_source = 'filesystem'")


def log_tail(log: DataFrame, since: int, last: int = 500) -> DataFrame:
    """Lines after ``since``; without one the last few."""
    return log.where(F.col("id") > since) if since > 0 else log.orderBy(F.desc("id")).limit(last)
