"""Registered queries over files: JSON, GPX and JPEG files that Spark writes from the test tables and reads back, and SQL over the tables."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterlake.functions import exprs, sql
from shutterlake.operators import library, listings
from shutterlake.operators.scratch import removed, shared_dir
from shutterlake.sources import encode, images, jpeg, readers, roots, sinks, takeout

from . import fixtures as fx
from .catalogue import G, P, query


def _folder(df: DataFrame, what: str) -> str:
    return f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"


def _parts(files: float) -> int:
    """Tasks for so many files: each takes about 500, however few parts the table has that they come from."""
    return max(1, math.ceil(files / 500))


def _documents(lines: DataFrame, head: str, between: str, tail: str, what: str) -> str:
    """A folder with a file for each part of ``lines`` (line): head, lines with a text between them, tail."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = lambda rows: pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], names=["line"])
        yield text([head])
        first = True
        for batch in batches:
            rows = batch.column("line").to_pylist()
            if rows:
                yield text([r if first and not k else between + r for k, r in enumerate(rows)])
                first = False
        yield text([tail])

    at = _folder(lines, what)
    lines.select("line").mapInArrow(run, "line string").write.text(at)
    return at


#: Times with a zone of their own, records that lack something, and nested ones.
POINTS = "(select event_id as id, ts, event_id * 7919 % 1800000000 - 900000000 as lat, event_id * 104729 % 3600000000 - 1800000000 as lon, event_id % 10 as kind from events)"
_ZONE = "case when kind = 3 then interval 2 hour else interval 0 hour end"
_READ = f"select cast(epoch_us(date_trunc('millisecond', ts) - ({_ZONE})) as bigint) as us, cast(lat as double) / 1e7 as lat, cast(lon as double) / 1e7 as lon from {POINTS} p where kind not in (5, 6, 7)"


def _time() -> Column:
    return F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.when(F.col("kind") == 3, "+02:00").otherwise("Z"))


@query(_READ, POINTS[1:-1])
def takeout_points(points):
    """Location histories in JSON, each read by several tasks."""
    time = F.when(F.col("kind") != 5, F.when(F.col("kind") == 6, "no time").otherwise(_time()))
    nested = F.array(F.struct(F.lit("x{[\"").alias("timestamp"), F.lit(1).alias("latitudeE7")))
    record = F.struct(time.alias("timestamp"), nested.alias("activity"), F.when(F.col("kind") != 7, F.col("lat")).alias("latitudeE7"), F.col("lon").alias("longitudeE7"))
    at = _documents(points.select(F.to_json(record).alias("line")), '{"settings": [{"latitudeE7": 1}], "locations": [', ",", "]}", "takeout")
    rows = takeout.records(points.sparkSession, at, piece=1 << 18)
    return readers._points(rows, "timestamp", F.col("lat"), F.col("lon"))


@query(_READ, POINTS[1:-1])
def gpx_points(points):
    place = F.concat(F.lit('<trkpt lat="'), (F.col("lat") / 1e7).cast("string"), F.lit('"'), F.when(F.col("kind") == 7, "").otherwise(F.concat(F.lit(' lon="'), (F.col("lon") / 1e7).cast("string"), F.lit('"'))), F.lit(">"))
    time = F.when(F.col("kind") == 5, "").otherwise(F.concat(F.lit("<time> "), F.when(F.col("kind") == 6, "no time").otherwise(_time()), F.lit(" </time>")))
    line = F.concat(place, F.lit("<ele>1</ele>"), time, F.lit("</trkpt>"))
    at = _documents(points.select(line.alias("line")), '<gpx xmlns="urn:x"><trk><trkseg>', "", "</trkseg></trk></gpx>", "gpx")
    return readers.gpx(points.sparkSession, at)


PICTURES = "(select p_partkey as n, concat('d', cast(p_partkey % 7 as string), case when p_partkey % 11 = 0 then '/_duplicates' else '' end, '/p', cast(p_partkey as string), case p_partkey % 4 when 0 then '.JPG' when 1 then '.jpeg' when 2 then '.txt' else '.jpg' end) as id, p_name as name from part)"
_HEX = "ffd8ffe1002a45786966000049492a0008000000010010010200080000001a00000000000000"


#: Bytes of files that lie on disk at once.
TREE_BYTES = 1 << 30


@query(f"""with c as (select *, 'CAM' || lpad(cast(n % 50 as varchar), 4, '0') as camera, unhex('{_HEX}') || ('CAM' || lpad(cast(n % 50 as varchar), 4, '0'))::blob || unhex('00ffda0002ffd9') || repeat('x', cast(n % 3 * 40000 as int))::blob as content from {PICTURES} p
where n % 4 <> 2 and n % 11 <> 0)
select id, split_part(id, '/', 2) as filename, split_part(id, '/', 1) as folder, cast(round_even(octet_length(content) / 1024.0, 0) as bigint) as size_kb, md5(content[1:65536]) as file_hash, camera from c""", PICTURES[1:-1])
def photo_scan(pictures):
    """Trees of files in several folders, scanned: other suffixes and the folder for duplicates left out; sizes, hashes and cameras from the bytes.

    A tree holds about ``TREE_BYTES``; it goes before the next one is written, so disk doesn't grow with the table.
    """
    spark = pictures.sparkSession
    body = F.concat(jpeg.sample_jpeg(F.format_string("CAM%04d", F.col("n") % 50)), F.expr("cast(repeat('x', cast(n % 3 * 40000 as int)) as binary)"))
    count, size = pictures.agg(F.count("*"), F.coalesce(F.sum(F.col("n") % 3 * 40_000), F.lit(0))).first()
    schema = "id string, filename string, folder string, size_kb long, file_hash string, camera string"
    if not count:
        return spark.createDataFrame([], schema)
    trees = max(1, math.ceil(size / TREE_BYTES))
    parts = _parts(count / trees)
    at = _folder(pictures, "scanned")

    def write(rows) -> None:
        for row in rows:
            store, path = sinks.opened(row["path"])
            store.create_dir(path[: path.rfind("/")])
            sinks.put(row["path"], bytes(row["content"]))

    for k in range(trees):
        root = _folder(pictures, "tree")
        # dealt out before bodies are made
        some = pictures.where(F.pmod(F.xxhash64("n"), F.lit(trees)) == k).select("n", "id").repartition(parts, "n")
        try:
            some.select(F.concat(F.lit(f"{root}/"), "id").alias("path"), body.alias("content")).foreachPartition(write)
            found = readers.photo_files(spark, root).coalesce(parts)
            kept = ["filename", "folder", "size_kb", "file_hash"]
            rows = readers.described(readers.metadata(found, kept), kept).select("id", *kept, "camera")
            rows.write.mode("append").parquet(at)
        finally:
            removed(spark, root)
    return spark.read.schema(schema).parquet(at)


TAGS = "(select l_orderkey, l_linenumber, l_orderkey % 5 as a, l_linenumber % 3 as b, l_shipdate from lineitem)"


@query(f"""select l_orderkey, l_linenumber, case when b <> 0 then cast(a as double) / b end as ratio,
case when a in (0, 1) then cast(l_shipdate as timestamp) when a = 2 then null when b = 0 then cast(l_shipdate as timestamp) + interval 1 day end as date_taken,
greatest(1, case when a = 3 then 60 else cast(l_linenumber as int) - 3 end) as minutes, case when b = 1 then (l_linenumber * 90 - 360 + 3600) % 360 end as turn from {TAGS} t""", TAGS[1:-1])
def tag_values(rows):
    """Ratios, dates from the first tag that is there, clamped tolerances, turns of JPEG files."""
    a, b = F.col("a"), F.col("b")
    text = lambda c: F.date_format(c, "yyyy:MM:dd HH:mm:ss")
    later = F.col("l_shipdate").cast("timestamp_ntz") + F.expr("interval 1 day")
    date = exprs.exif_date(F.when(a < 2, text("l_shipdate")).when(a == 2, "0000:00:00"), F.when(b == 0, text(later)))
    turn = exprs.rotation((F.col("l_linenumber") * 90 - 360).cast("int"), F.when(b == 1, ".JPG").otherwise(".nef"))
    clamp = exprs.tolerance_minutes(F.when(a == 3, "none").otherwise((F.col("l_linenumber") - 3).cast("string")))
    return rows.select("l_orderkey", "l_linenumber", exprs.rational(a, b).alias("ratio"), date.alias("date_taken"), clamp.alias("minutes"), turn.cast("long").alias("turn"))


@query(f"""with n as (select distinct photo_id, field from {G} where id % 9 = 0)
select id, photo_id, field, committed from {G} where committed or (photo_id, field) not in (select (photo_id, field) from n)
union all select id + 1000000, photo_id, field, false from (select max(id) as id, photo_id, field from {G} where id % 9 = 0 group by 2, 3) x""", fx.PENDING)
def pending_upsert(changes):
    more = changes.where("id % 9 = 0").groupBy("photo_id", "field").agg(F.max("id").alias("id"))
    more = more.select((F.col("id") + 1_000_000).alias("id"), "photo_id", "field", F.lit(None).cast("string").alias("new_value"), F.lit(False).alias("committed"))
    return library.staged(changes, more).select("id", "photo_id", "field", "committed")


@query(f"select id, coalesce(trim(location_name) = '' or regexp_full_match(trim(location_name), '[a-z0-9 ]+ digital camera', 'i'), true) as junk from ({fx.OLD}) o", fx.OLD)
def junk_desc_sql(rows):
    """The rule called from SQL."""
    spark = rows.sparkSession
    sql.register(spark)
    return spark.sql("select id, is_junk_desc(location_name) as junk from {rows}", rows=rows)


TRACK = "(select event_id % 5 as import_id, event_id * 1000003 as us, cast(event_id % 90 as double) as lat, cast(event_id % 180 as double) as lon from events)"


@query(f"select us, lat, lon from {TRACK} t where import_id = 3 and us >= 500000000", TRACK[1:-1])
def track_sql(points):
    """An import's points from a time on, by a table function."""
    spark = points.sparkSession
    sql.register_track(spark, points)
    return spark.sql("select * from track(3, 500000000, null)")


TURNS = "select user_id as number, count(*) as n from events where user_id % 4 < 2 group by user_id"


@query(f"select distinct p.id, p.scan_root, p.status from {P} where p.scan_root in (select concat('/r', cast(number % 20 as varchar)) from ({TURNS}) t where n >= 2)", fx.PHOTOS, TURNS)
def library_of_roots(photos, scans):
    """The library laid out by root; reading the roots of some scans leaves other folders alone."""
    at = _folder(photos, "library")
    roots.save(photos.select("id", "scan_root", "status").distinct(), at)
    library = roots.load(photos.sparkSession, at, "id string, status string, scan_root string")
    some = scans.where("n >= 2").select(F.concat(F.lit("/r"), F.col("number") % 20).alias("scan_root")).distinct()
    return roots.of_roots(library, some).select("id", "scan_root", "status")


SQUARES = "select s_suppkey as number, s_suppkey * 7 % 256 as level, s_suppkey % 50 + 1 as width, s_suppkey % 30 + 1 as height from supplier"


@query(f"select number, width, height, cast(level as bigint) as darkest, cast(level as bigint) as lightest from ({SQUARES}) s", SQUARES)
def pictures_read_back(squares):
    """Grey pictures encoded as JPEG files at full quality and decoded by Spark."""
    root = _folder(squares, "pictures")

    def write(rows) -> None:
        for row in rows:
            at = f"{root}/{row['number'] % 16}/{row['number']}.jpg"
            store, path = sinks.opened(at)
            store.create_dir(path[: path.rfind("/")])
            sinks.put(at, encode.jpeg(np.full((int(row["height"]), int(row["width"]), 3), int(row["level"]), np.uint8), 100))

    parts = _parts(squares.count())
    squares.repartition(parts, "number").foreachPartition(write)
    number = F.regexp_extract("path", r"(\d+)\.jpg$", 1).cast("long")
    found = images.pictures(squares.sparkSession, root).coalesce(parts).mapInPandas(images.levels, "path string, height long, width long, darkest long, lightest long")
    return found.select(number.alias("number"), "width", "height", "darkest", "lightest")
