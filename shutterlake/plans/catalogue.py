"""The library's registered queries over the test tables, and SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.functions import exprs
from shutterlake.operators import dedup, library, temporal

from . import fixtures as fx

TABLES = ("events", "part", "documents", "lineitem", "embeddings", "customer", "orders", "nation", "supplier")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A fixture's SQL over the tables in ``sf_dir``."""
    names = [t for t in TABLES if f"from {t}" in sql]
    return spark.sql(_inlined(sql, names), **{f"_{t}": spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in names})


def _inlined(sql: str, names: list[str]) -> str:
    for t in names:
        sql = sql.replace(f"from {t}", f"from {{_{t}}}")
    return sql


def query(sql: str | None, *sources: str):
    """Registers a function of the fixtures' DataFrames, with its oracle."""

    def register(build: Callable[..., DataFrame]):
        QUERIES[build.__name__] = lambda spark, sf_dir: build(*(view(spark, sf_dir, s) for s in sources))
        if sql:
            ORACLES[build.__name__] = sql
        return build

    return register


P, C, G = f"({fx.PHOTOS}) p", f"({fx.COORDS}) c", f"({fx.PENDING}) g"
LATEST = f"(select * from (select *, max(id) over (partition by photo_id, field) as top from {G} where not committed) x where id = top)"


@query(f"select status, count(*) as n from {P} group by status", fx.PHOTOS)
def status_counts(photos):
    return photos.groupBy("status").agg(F.count("*").alias("n"))


@query(f"""
with s as (select scan_root, ord, epoch_us(date_taken) as us, lat, lon, filename from {P} where has_gps),
t as (select scan_root, ord, epoch_us(date_taken) as us from {P} where status = 'unknown'),
r as (select t.ord, s.lat as near_lat, s.lon as near_lon, s.filename as near_filename, abs(s.us - t.us) as d,
             row_number() over (partition by t.ord order by abs(s.us - t.us), s.us >= t.us, case when s.us < t.us then -s.ord else s.ord end) as k
      from t join s on s.scan_root = t.scan_root and abs(s.us - t.us) <= 14400000000)
select ord, near_lat, near_lon, near_filename, cast(round_even(d / 60000000.0, 0) as bigint) as delta_min from r where k = 1""", fx.PHOTOS)
def nearest_sibling(photos):
    rows = photos.withColumn("is_target", F.col("status") == "unknown")
    near = temporal.nearest_in_group(rows, "scan_root", "date_taken", "ord", "has_gps", "is_target", 240 * temporal.MINUTE, ["lat", "lon", "filename"])
    return near.select("ord", "near_lat", "near_lon", "near_filename", exprs.minutes(F.col("near_us")).alias("delta_min"))


@query(f"""
with s as (select ord, epoch_us(date_taken) as us, lat, lon from {P} where has_gps),
t as (select ord, epoch_us(date_trunc('second', date_taken)) as us from {P} where not has_gps and coalesce(location_name, '') = ''),
r as (select t.ord, s.ord as near_ord, s.lat as near_lat, s.lon as near_lon, abs(s.us - t.us) as d,
             row_number() over (partition by t.ord order by abs(s.us - t.us), s.us >= t.us, case when s.us < t.us then -s.ord else s.ord end) as k
      from t join s on abs(s.us - t.us) <= 600000000)
select ord, near_ord, near_lat, near_lon, cast(round_even(d / 60000000.0, 0) as bigint) as delta_min from r where k = 1""", fx.PHOTOS)
def nearest_history(photos):
    points = photos.where("has_gps").select(temporal.micros(F.col("date_taken")).alias("us"), "ord", F.col("ord").alias("p"), "lat", "lon")
    probes = photos.where(~F.col("has_gps") & exprs.blank(F.col("location_name"))).select("ord", temporal.micros(F.date_trunc("second", F.col("date_taken").cast("timestamp"))).alias("us"))
    near = temporal.nearest_overall(probes, points, 10 * temporal.MINUTE, ["p", "lat", "lon"])
    return near.select("ord", F.col("near_p").alias("near_ord"), "near_lat", "near_lon", exprs.minutes(F.col("near_us")).alias("delta_min"))


@query(f"""
with o as (select photo_id, try_cast(arg_max(case when field = 'lat' then new_value end, case when field = 'lat' then id end) as double) as a,
                  try_cast(arg_max(case when field = 'lon' then new_value end, case when field = 'lon' then id end) as double) as b from {C} where not committed group by photo_id)
select p.ord, case when a is not null and b is not null then a else lat end as lat, case when a is not null and b is not null then b else lon end as lon,
       has_gps or (a is not null and b is not null) as has_gps from {P} left join o on o.photo_id = p.id""", fx.PHOTOS, fx.COORDS)
def effective_gps(photos, coords):
    return temporal.effective_positions(photos, coords).select("ord", "lat", "lon", "has_gps")


@query(f"select distinct p.ord from {P} join {C} on c.photo_id = p.id where p.scan_root = '/r3' and not c.committed", fx.PHOTOS, fx.COORDS)
def pending_overlay(photos, coords):
    return photos.where("scan_root = '/r3'").join(temporal.uncommitted(coords).select(F.col("photo_id").alias("id")), "id", "left_semi").select("ord")


@query(f"""with n as (select id, status as was, case when status = 'unknown' and id % 7 = 0 then 'inferred' else status end as status from ({fx.OLD}) o)
select id, status from n where status = 'inferred' and was <> 'inferred'""", fx.OLD)
def changed_rows(old):
    after = old.withColumn("status", F.when((F.col("status") == "unknown") & (F.col("id") % 7 == 0), "inferred").otherwise(F.col("status")))
    before = old.select("id", F.col("status").alias("was"))
    return after.join(before, "id").where("status = 'inferred' and was <> 'inferred'").select("id", "status")


@query(f"select file_hash as key, ord, n as size from (select *, count(*) over (partition by file_hash) as n from ({fx.HASHED}) h) x where n > 1 and file_hash <> ''", fx.HASHED)
def dup_exact(rows):
    return dedup.exact(rows)


NAMES = rf"(select ord, lower(regexp_replace(filename, '^(.+?)(\s*\(\d+\))(\.[^.]+)$', '\1\3')) as key from ({fx.FILES}) f)"


@query(f"select key, ord, n as size from (select *, count(*) over (partition by key) as n from {NAMES} y) x where n > 1", fx.FILES)
def dup_filename(rows):
    return dedup.by_filename(rows)


PAIRS = f"""(select a.id as a, b.id as b, cast(bit_count(xor(a.phash, b.phash)) as int) as pd from ({fx.PHASHES_DUCKDB}) a join ({fx.PHASHES_DUCKDB}) b on a.id < b.id and bit_count(xor(a.phash, b.phash)) <= 10)"""


def _hashes(rows):
    return rows.withColumn("dhash", F.lit(None).cast("bigint"))


@query(f"select a, b, pd, 99 as dd from {PAIRS} x", fx.PHASHES)
def hamming_pairs(rows):
    return dedup.hamming_pairs(_hashes(rows))


@query(f"select a, b, cast(round_even((1 - pd / 64.0) * 100, 0) as int) as similarity from {PAIRS} x", fx.PHASHES)
def similarity(rows):
    return dedup.hamming_pairs(_hashes(rows)).select("a", "b", exprs.similarity(F.col("pd"), F.col("dd")).alias("similarity"))


#: Star clusters over planted families: seeds have no earlier neighbour that is one. Families of four are decided in three rounds.
STARS = f"""pr as (select * from {PAIRS} x),
s1 as (select distinct a as id from pr where a not in (select b from pr)),
c1 as (select b as id, min(a) as seed from pr where a in (select id from s1) group by b),
l1 as (select * from pr where a not in (select id from s1) and a not in (select id from c1) and b not in (select id from c1)),
s2 as (select distinct a as id from l1 where a not in (select b from l1)),
c2 as (select b as id, min(a) as seed from l1 where a in (select id from s2) group by b),
l2 as (select * from l1 where a not in (select id from s2) and a not in (select id from c2) and b not in (select id from c2)),
s3 as (select distinct a as id from l2 where a not in (select b from l2)),
c3 as (select b as id, min(a) as seed from l2 where a in (select id from s3) group by b),
st as (select * from c1 union all select * from c2 union all select * from c3)"""
EXACT_KEYS, NAME_KEYS = f"select file_hash from ({fx.HASHED}) h group by 1 having count(*) > 1", f"select key from {NAMES} y group by 1 having count(*) > 1"


@query(f"""with {STARS}, n as (select (select count(*) from ({EXACT_KEYS}) x) as exact_groups, (select count(*) from ({NAME_KEYS}) z) as filename_groups,
(select count(distinct seed) from st) as perceptual_groups, (select count(*) from ({fx.HASHED}) h) as scanned)
select *, exact_groups + filename_groups + perceptual_groups as total_groups from n""", fx.HASHED, fx.FILES, fx.PHASHES)
def dup_summary(rows, files, hashes):
    return dedup.summary(rows, dedup.exact(rows), dedup.by_filename(files), dedup.perceptual(_hashes(hashes)))


@query(f"""with {STARS} select seed, id as member, cast(round_even((1 - pd / 64.0) * 100, 0) as int) as similarity, 'phash' as match_on from st join pr on a = seed and b = id
union all select distinct seed, seed, 100, 'seed' from st""", fx.PHASHES)
def dup_perceptual(rows):
    return dedup.perceptual(_hashes(rows))


@query(f"""with m as (select ord, file_hash, case ord % 5 when 0 then 'named' when 1 then 'gps' when 2 then 'history' when 3 then 'inferred' else 'unknown' end as status, ord % 17 as size_kb from ({fx.HASHED}) h),
r as (select ord, row_number() over (partition by file_hash order by list_position(['gps','named','history','inferred','unknown'], status), size_kb desc, ord) as k, count(*) over (partition by file_hash) as n from m)
select ord, k = 1 as keep from r where n > 1""", fx.HASHED)
def auto_pick_best(rows):
    status = F.element_at(F.array(*map(F.lit, ("named", "gps", "history", "inferred", "unknown"))), (F.col("ord") % 5 + 1).cast("int"))
    members = dedup.exact(rows).withColumns({"status": status, "size_kb": F.col("ord") % 17})
    return dedup.best_copies(members, "key", "status", "size_kb", "ord").select("ord", "keep")


JUNK = "(o.location_name is null or trim(o.location_name) = '' or regexp_full_match(trim(o.location_name), '[a-z0-9 ]+ digital camera', 'i'))"


@query(f"""select coalesce(n.id, o.id) as id,
case when n.id is null then o.location_name when n.location_name is not null then n.location_name when o.id is not null and not {JUNK} then o.location_name end as location_name,
case when n.id is null then o.status when o.id is not null and o.status in ('named','gps','history') and n.status = 'unknown' and not (o.status = 'named' and {JUNK}) then o.status else n.status end as status
from ({fx.OLD}) o full outer join ({fx.NEW}) n on o.id = n.id""", fx.OLD, fx.NEW)
def photo_upsert(old, new):
    return library.upsert(old, new)


FILETIMES = "(select p_partkey as id, cast(p_partkey % 90 as double) as file_mtime from part)"
KNOWN = "(select p_partkey as id, case when p_partkey % 13 <> 0 then cast((p_partkey + p_partkey % 4) % 90 as double) end as file_mtime from part where p_partkey % 7 <> 0)"


@query(f"select f.id from {FILETIMES} f left join {KNOWN} k on k.id = f.id where k.id is null or abs(f.file_mtime - coalesce(k.file_mtime, 0)) > 1", FILETIMES[1:-1], KNOWN[1:-1])
def rescan_diff(files, known):
    return library.to_rescan(files, known).select("id")


@query(f"select location_name, count(*) as n, round(avg(lat), 6) as avg_lat, round(avg(lon), 6) as avg_lon from {P} where coalesce(location_name, '') <> '' and lat is not null and lon is not null group by location_name order by n desc, location_name limit 8", fx.PHOTOS)
def frequent_places(photos):
    return library.frequent_places(photos)


@query(f"select ord from {P} where has_gps and coalesce(location_name, '') = ''", fx.PHOTOS)
def needs_geocode(photos):
    return photos.where(F.col("has_gps") & exprs.blank(F.col("location_name"))).select("ord")


@query(f"select id, folder, status, lat, lon from {P} where scan_root = '/r5'", fx.PHOTOS)
def scan_result(photos):
    return photos.where("scan_root = '/r5'").select("id", "folder", "status", "lat", "lon")


TEXTS = "(select doc_id as id, case doc_id % 6 when 0 then 'OLYMPUS DIGITAL CAMERA' when 1 then ' nikon digital camera ' when 2 then 'digital camera' when 3 then '  ' when 4 then concat(source, ' digital camera') end as text from documents)"


@query(f"select id, coalesce(trim(text) = '' or regexp_full_match(trim(text), '[a-z0-9 ]+ digital camera', 'i'), true) as junk from {TEXTS} t", TEXTS[1:-1])
def junk_desc(rows):
    return rows.select("id", exprs.junk_description(F.col("text")).alias("junk"))


SPOTS = "(select event_id as id, cast(event_id % 3 - 1 as double) as lat, cast(event_id % 5 - 2 as double) as lon, case when event_id % 4 = 0 then '' when event_id % 4 = 1 then 'Here' end as name from events)"


@query(f"select id from {SPOTS} s where abs(lat) > 1e-6 or abs(lon) > 1e-6", SPOTS[1:-1])
def null_island(rows):
    return rows.where(exprs.real_position(F.col("lat"), F.col("lon"))).select("id")


@query(f"select id, case when lat <> 0 and lon <> 0 then 'gps' when coalesce(name, '') <> '' then 'named' else 'unknown' end as status from {SPOTS} s", SPOTS[1:-1])
def save_status(rows):
    return rows.select("id", exprs.saved_status(F.col("lat"), F.col("lon"), F.col("name")).alias("status"))


@query(f"select ord, status = 'unknown' as selected from {P} where coalesce(location_name, '') = '' and exists (select 1 from {P.replace(') p', ') q')} where q.scan_root = p.scan_root and q.folder = p.folder and coalesce(q.location_name, '') <> '')", fx.PHOTOS)
def propagate_targets(photos):
    return library.propagation_targets(photos).select("ord", "selected")


@query(f"select ord from {P} where date_source = 'filesystem' and exists (select 1 from {P.replace(') p', ') q')} where q.scan_root = p.scan_root and q.folder = p.folder and q.date_source = 'exif')", fx.PHOTOS)
def push_date_targets(photos):
    return library.date_targets(photos).select("ord")


@query(f"select id, photo_id, field, new_value from {LATEST} l", fx.PENDING)
def pending_latest(changes):
    return library.latest_pending(changes).select("id", "photo_id", "field", "new_value")


@query(f"select p.filename, g.field, g.new_value from {G} join {P} on p.ord = g.photo_id where not g.committed and p.scan_root = '/r1'", fx.PENDING, fx.PHOTOS)
def pending_review(changes, photos):
    rows = photos.where("scan_root = '/r1'").select(F.col("ord").alias("photo_id"), "filename")
    return changes.where("not committed").join(rows, "photo_id").select("filename", "field", "new_value").orderBy("filename", "field")


_AT = "arg_max(case when field = '{f}' then new_value end, case when field = '{f}' then id end)"
PIVOT = f"(select photo_id, {', '.join(_AT.format(f=f) + ' as ' + f for f in library.FIELDS)} from {G} where not committed group by photo_id)"


@query(f"select photo_id, lat, lon, location_name, date_taken, rename from {PIVOT} x", fx.PENDING)
def pending_pivot(changes):
    return library.pivoted(changes.where("not committed")).select("photo_id", "lat", "lon", "location_name", "date_taken", "rename")


_FULL = "coalesce({c}, '') <> ''"
_SOME = " or ".join(_FULL.format(c=c) for c in ("location_name", "lat", "lon", "date_taken"))


@query(f"select photo_id, {_FULL.format(c='move_to_duplicates')} as move, ({_SOME}) and not {_FULL.format(c='move_to_duplicates')} as write, {_FULL.format(c='rotate_degrees')} as rotate, {_FULL.format(c='rename')} as rename from {PIVOT} x", fx.PENDING)
def commit_plan(changes):
    return library.commit_plan(changes.where("not committed"))


@query(f"select ord as photo_id, field, new_value from (select ord, 'status' as field, status as new_value from {P} union all select ord, 'location_name', location_name from {P} union all select ord, 'folder', folder from {P}) x where new_value is not null", fx.PHOTOS)
def stage_changes(photos):
    return library.wide_to_changes(photos, "ord", ["status", "location_name", "folder"])


@query(f"select l_orderkey, l_linenumber, round(case when ref in ('S','W') then -(d + m/60 + s/3600) else d + m/60 + s/3600 end, 9) as value from ({fx.DMS}) x", fx.DMS)
def dms_to_decimal(rows):
    return rows.select("l_orderkey", "l_linenumber", F.round(exprs.dms_to_decimal(F.col("d"), F.col("m"), F.col("s"), F.col("ref")), 9).alias("value"))


@query(f"""select ord, cast(floor(abs(lat)) as bigint) as deg, cast(floor((abs(lat) - floor(abs(lat))) * 60) as bigint) as min,
cast(round_even(((abs(lat) - floor(abs(lat))) * 60 - floor((abs(lat) - floor(abs(lat))) * 60)) * 60 * 100, 0) as bigint) as sec100, case when lat >= 0 then 'N' else 'S' end as ref from {P} where has_gps""", fx.PHOTOS)
def decimal_to_dms(photos):
    parts = exprs.decimal_to_dms(F.col("lat"), "N", "S")
    return photos.where("has_gps").select("ord", *(c.alias(k) for k, c in parts.items()))


CAMERAS = "(select p_partkey as id, case p_partkey % 4 when 0 then 'Canon' when 1 then ' NIKON ' when 2 then '' end as make, case p_partkey % 5 when 0 then 'Canon EOS 5D' when 1 then 'nikon D5' when 2 then 'X100' when 3 then ' ' end as model from part)"


@query(f"""select id, case when a <> '' and b <> '' and starts_with(lower(b), lower(a)) then b when trim(concat(a, ' ', b)) <> '' then trim(concat(a, ' ', b)) end as camera
from (select id, trim(coalesce(make, '')) as a, trim(coalesce(model, '')) as b from {CAMERAS} c) x""", CAMERAS[1:-1])
def camera_name(rows):
    return rows.select("id", exprs.camera_name(F.col("make"), F.col("model")).alias("camera"))


RATIOS = "(select p_partkey as id, cast(p_partkey * 7919 % 90001 as double) as num, cast(p_partkey % 40 as double) as den from part)"


@query(f"""select id, case when num <> 0 and den <> 0 then case when num < den then cast(num::bigint as varchar) || '/' || cast(den::bigint as varchar) || 's' else printf('%g', num / den) || 's' end end as shutter from {RATIOS} r""", RATIOS[1:-1])
def shutter_text(rows):
    return rows.select("id", exprs.shutter_text(F.col("num"), F.col("den")).alias("shutter"))


PLACES = "(select doc_id as id, case doc_id % 3 when 0 then 'Rio de Janeiro, Brazil' when 1 then concat('Smith & Sons <', source, '>  Farm!') else ' a\tb ' end as name from documents)"


@query(rf"select id, regexp_replace(trim(regexp_replace(name, '[^A-Za-z0-9._ -]', '', 'g')), '\s+', '_', 'g') as slug from {PLACES} p", PLACES[1:-1])
def slugify(rows):
    return rows.select("id", exprs.slug(F.col("name")).alias("slug"))


@query(rf"""with s as (select *, coalesce(strftime(date_taken, '%Y-%m-%d'), 'nodate') as day, row_number() over (partition by strftime(date_taken, '%Y-%m-%d') order by ord) as k from {P}),
n as (select ord, trim(regexp_replace(day || '_' || strftime(date_taken, '%H%M%S') || '_' || regexp_replace(coalesce(location_name, ''), ' ', '_', 'g') || '_' || case when k < 1000 then lpad(cast(k as varchar), 3, '0') else cast(k as varchar) end, '[_ -]{{2,}}', '_', 'g'), '_ -') as name from s)
select ord, name || '.jpg' as new_name from n""", fx.PHOTOS)
def rename_preview(photos):
    return library.rename_preview(photos, "{date}_{time}_{location}_{seq}", "ord").select("ord", "new_name")


_XMP = library.SIDECAR.replace("'", "''").split("%s")
_ESC = "replace(replace(replace(location_name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query(f"""select ord, md5('{_XMP[0]}' || coalesce({_ESC}, '') || '{_XMP[1]}' || coalesce(printf('%.6f', abs(lat)) || case when lat >= 0 then 'N' else 'S' end, '') || '{_XMP[2]}' ||
coalesce(printf('%.6f', abs(lon)) || case when lon >= 0 then 'E' else 'W' end, '') || '{_XMP[3]}' || folder || '{_XMP[4]}') as xmp_md5 from {P}""", fx.PHOTOS)
def xmp_payload(photos):
    return library.sidecar(photos.withColumn("date_taken", F.col("folder"))).select("ord", F.md5(F.col("xmp").cast("binary")).alias("xmp_md5"))


ADDRESSES = "(select c_custkey as id, case when c_custkey % 3 = 0 then c_name end as city, case when c_custkey % 4 = 0 then c_mktsegment end as village, case when c_custkey % 5 > 0 then 'Land' end as country, c_name as display from customer)"


@query(f"select id, case when concat_ws(', ', coalesce(city, village), country) <> '' then concat_ws(', ', coalesce(city, village), country) else display end as place from {ADDRESSES} a", ADDRESSES[1:-1])
def place_name(rows):
    none = F.lit(None).cast("string")
    parts = {"city": F.col("city"), "town": none, "village": F.col("village"), "municipality": none, "county": none, "country": F.col("country")}
    return rows.select("id", exprs.place_name(parts, F.col("display")).alias("place"))


#: Phrases by which an answer is no place.
REFUSALS = ("i don't", "i cannot", "i'm unable", "no access", "image file", "photo file")
ANSWERS = "(select doc_id as id, case doc_id % 4 when 0 then 'Lisbon' when 1 then 'I cannot say' when 2 then text else 'An Image File' end as answer, source as seed from documents)"


@query(f"select id, case when length(answer) > 60 or {' or '.join('contains(lower(answer), ' + chr(39) + r.replace(chr(39), chr(39) * 2) + chr(39) + ')' for r in REFUSALS)} then seed else answer end as answer from {ANSWERS} a", ANSWERS[1:-1])
def answer_sanitise(rows):
    return rows.select("id", exprs.sanitised_answer(F.col("answer"), F.col("seed"), REFUSALS).alias("answer"))


@query("select user_id % 9 as import_id, count(*) as points from events group by 1", "select user_id % 9 as import_id from events")
def import_counts(points):
    return points.groupBy("import_id").agg(F.count("*").alias("points"))


IMPORTED = "(select event_id as id, user_id % 9 as history_import_id, value as history_lat, case when event_type = 'view' then 'gps' else 'history' end as status from events)"


@query(f"select id, case when history_import_id <> 4 then history_import_id else -1 end as history_import_id, case when history_import_id <> 4 then history_lat end as history_lat, case when history_import_id = 4 and status = 'history' then 'unknown' else status end as status from {IMPORTED} i", IMPORTED[1:-1], "select user_id % 9 as import_id from events")
def import_delete(photos, points):
    return library.without_import(photos, points, 4)[0].withColumn("history_import_id", F.coalesce("history_import_id", F.lit(-1)))


@query("select cast(cast(ts as date) as varchar) as day, count(*) as used, greatest(0, 300 - count(*)) as remaining from events group by 1", "select ts from events")
def daily_quota(calls):
    return library.daily_quota(calls, "ts", 300).withColumn("day", F.col("day").cast("string"))


@query("select concat('P', cast(user_id % 70 as varchar)) as name, max(event_id) as ord from events group by 1 order by ord desc limit 50", "select concat('P', cast(user_id % 70 as string)) as name, event_id as ord from events")
def saved_places_cap(places):
    return library.saved_places(places)


@query("select event_id as id from events where event_id > 900", "select event_id as id from events")
def log_tail(log):
    return library.log_tail(log, 900)
