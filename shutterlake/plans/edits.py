"""Registered queries of what users and background passes change, over the test tables, and SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from shutterlake.functions import exprs
from shutterlake.operators import dedup, edits, inference, library, listings, renames
from shutterlake.sources import jpeg, readers, sinks

from . import fixtures as fx
from .catalogue import LATEST, C, G, P, query

GAZETTEER = "(select cast(n_nationkey * 7 - 89 as double) as lat, cast(n_nationkey * 14 - 179 as double) as lon, n_name as name from nation union all select cast(p_partkey % 180 - 90 as double), cast(p_partkey * 7 % 360 - 180 as double), concat('Town ', cast(p_partkey % 500 as string)) from part)"
CELLS = f"(select floor(lat) as y, floor(lon) as x, min(name) as name from {GAZETTEER} z group by 1, 2)"

_OVER = f"""o as (select photo_id, try_cast(arg_max(case when field = 'lat' then new_value end, case when field = 'lat' then id end) as double) as a,
                  try_cast(arg_max(case when field = 'lon' then new_value end, case when field = 'lon' then id end) as double) as b from {C} where not committed group by photo_id),
e as (select p.*, a is not null and b is not null as over, case when a is not null and b is not null then a else lat end as elat, case when a is not null and b is not null then b else lon end as elon from {P} left join o on o.photo_id = p.id)"""


@query(f"""with {_OVER},
s as (select *, epoch_us(date_taken) as us from e where (has_gps or over) and elat is not null and elon is not null),
t as (select *, epoch_us(date_taken) as us from e where not has_gps and status not in ('named', 'inferred', 'history') and id not in (select photo_id from {C} where not committed)),
r as (select t.ord, s.elat, s.elon, s.filename as f, s.location_name as l, abs(s.us - t.us) as d,
             row_number() over (partition by t.ord order by abs(s.us - t.us), s.us >= t.us, case when s.us < t.us then -s.ord else s.ord end) as k
      from t join s on s.scan_root = t.scan_root and abs(s.us - t.us) <= 14400000000),
m as (select r.*, case when coalesce(l, '') <> '' then l else g.name end as name from r left join {CELLS} g on g.y = floor(elat) and g.x = floor(elon) where k = 1)
select p.ord, m.elat as inferred_lat, m.elon as inferred_lon, m.f as inferred_from, cast(round_even(m.d / 60000000.0, 0) as bigint) as inferred_delta_min,
       case when m.ord is not null then 'inferred' else p.status end as status, coalesce(m.name, p.location_name) as location_name from {P} left join m on m.ord = p.ord""", fx.PHOTOS, fx.COORDS, GAZETTEER)
def inferred_locations(photos, coords, places):
    out = inference.inferred(photos, coords, inference.gazetteer(places))
    return out.select("ord", "inferred_lat", "inferred_lon", "inferred_from", "inferred_delta_min", "status", "location_name")


@query(f"""with s as (select ord, epoch_us(date_taken) as us, lat, lon, ord % 5 as import_id from {P} where has_gps),
t as (select ord, epoch_us(date_trunc('second', date_taken)) as us from {P} where not has_gps and coalesce(location_name, '') = ''),
r as (select t.ord, s.lat, s.lon, s.import_id, abs(s.us - t.us) as d, row_number() over (partition by t.ord order by abs(s.us - t.us), s.us >= t.us, case when s.us < t.us then -s.ord else s.ord end) as k
      from t join s on abs(s.us - t.us) <= 300000000)
select p.ord, r.lat as history_lat, r.lon as history_lon, cast(round_even(r.d / 60000000.0, 0) as bigint) as history_delta_min, r.import_id as history_import_id,
       case when r.ord is not null then 'history' else p.status end as status, p.location_name from {P} left join r on r.ord = p.ord and k = 1""", fx.PHOTOS)
def history_update(photos):
    points = photos.where("has_gps").selectExpr("unix_micros(cast(date_taken as timestamp)) as us", "ord", "lat", "lon", "ord % 5 as import_id")
    return inference.matched(photos, points, 5).select("ord", "history_lat", "history_lon", "history_delta_min", "history_import_id", "status", "location_name")


@query(f"""select ord, coalesce(case when has_gps and coalesce(location_name, '') = '' then g.name end, location_name) as location_name,
case when has_gps and coalesce(location_name, '') = '' and g.name is not null then 'gps' else status end as status from {P} left join {CELLS} g on g.y = floor(p.lat) and g.x = floor(p.lon)""", fx.PHOTOS, GAZETTEER)
def geocode_update(photos, places):
    return inference.geocoded(photos, inference.gazetteer(places)).select("ord", "location_name", "status")


@query(f"""with q as (select p.ord, p.id, p.folder, p.filename from {P} where p.ord % 50 = 0),
n as (select q.ord, q.id, q.folder, q.filename, string_agg('  - ' || s.filename || ': ' || coalesce(s.location_name, 'None') || ' (' || s.folder || ')', chr(10) order by s.ord) as near
      from q left join {P.replace(') p', ') s')} on s.scan_root = '/r' || cast(q.ord % 20 as varchar) and s.has_gps and s.ord > q.ord and s.ord <= q.ord + 60
      and (select count(*) from {P.replace(') p', ') u')} where u.scan_root = s.scan_root and u.has_gps and u.ord > q.ord and u.ord <= s.ord) <= 6 group by 1, 2, 3, 4)
select ord, 'Folder: ' || folder || chr(10) || 'Filename: ' || filename || coalesce(chr(10) || chr(10) || 'Nearby photos with known locations:' || chr(10) || near, '') as prompt from n""", fx.PHOTOS)
def suggestion_prompt(photos):
    asked = photos.where("ord % 50 = 0").select("ord", "id", "folder", "filename", F.concat(F.lit("/r"), (F.col("ord") % 20).cast("string")).alias("root"))
    near = photos.where("has_gps").select("scan_root", F.col("ord").alias("o"), F.col("filename").alias("f"), "location_name", F.col("folder").alias("date_taken"))
    # sixty numbers lie in two stretches of sixty, which are the key beside the root
    probes = asked.select("id", "ord", "root", F.explode(F.array(F.expr("ord div 60"), F.expr("ord div 60 + 1"))).alias("stretch"))
    near = near.withColumn("stretch", F.expr("o div 60"))
    pairs = probes.join(near, (F.col("root") == F.col("scan_root")) & (probes["stretch"] == near["stretch"]) & (F.col("o") > F.col("ord")) & (F.col("o") <= F.col("ord") + 60))
    pairs = pairs.select("id", F.col("o").alias("ord"), F.col("f").alias("filename"), "location_name", "date_taken")
    return inference.prompt(asked.withColumn("date_taken", F.lit(None).cast("string")), pairs).select("ord", "prompt")


_HASHED = fx.PHASHES_DUCKDB
_LEADER = "case when embedding[i+2] > embedding[i+1] then 1::ubigint << i::int else 0::ubigint end"
_DUCK_D = f"""(select v.vec_id as id, xor(b.d0, (((1::ubigint << (3*(v.vec_id % 4))::int) - 1) << 40)::ubigint) as dhash from embeddings v
join (select vec_id, list_sum(list_transform(range(63), lambda i: {_LEADER}))::ubigint as d0 from embeddings) b on b.vec_id = v.vec_id - v.vec_id % 4)"""
DHASHES = """
select v.vec_id as id, b.d0 ^ shiftleft(shiftleft(1L, int(3*(v.vec_id % 4))) - 1, 40) as dhash
from embeddings v join (select vec_id, aggregate(transform(sequence(0,62), i -> if(embedding[i+1] > embedding[i], shiftleft(1L,i), 0L)), 0L, (a,b) -> a|b) as d0 from embeddings) b
  on b.vec_id = v.vec_id - v.vec_id % 4"""


@query(f"""with h as (select p.id, case when p.id % 6 <> 1 then p.phash end as ph, case when p.id % 5 <> 2 then d.dhash end as dh from ({_HASHED}) p join {_DUCK_D} d on d.id = p.id where p.id % 11 <> 3),
x as (select a.id as a, b.id as b, coalesce(cast(bit_count(xor(a.ph, b.ph)) as int), 99) as pd, coalesce(cast(bit_count(xor(a.dh, b.dh)) as int), 99) as dd from h a join h b on a.id < b.id)
select * from x where pd <= 10 or dd <= 8""", fx.PHASHES, DHASHES)
def hamming_pairs_hex(phashes, dhashes):
    text = lambda c, gone: F.when(F.col("id") % gone[0] != gone[1], F.lower(F.hex(c)))
    rows = phashes.join(dhashes, "id").select("id", text("phash", (6, 1)).alias("phash"), F.when(F.col("id") % 11 == 3, "12zz").otherwise(text("dhash", (5, 2))).alias("dhash"))
    return dedup.hamming_pairs(dedup.from_hex(rows))


@query(f"""with g as (select key, ord from (select file_hash as key, ord, count(*) over (partition by file_hash) as n from ({fx.HASHED}) h) x where n > 1),
m as (select key as seed, ord as id from g), w as (select seed from m group by seed having bool_and(id % 3 <> 0)) select seed, id as member from m where seed not in (select seed from w)""", fx.HASHED)
def dup_not_exact(rows):
    groups = dedup.exact(rows).select(F.col("key").alias("seed"), F.col("ord").alias("member"))
    return dedup.outside(groups, rows.where("ord % 3 <> 0").select(F.col("ord").alias("id")))


@query(f"""select g.photo_id, p.filename, string_agg(g.field || '=' || g.new_value || '#' || cast(g.id as varchar), ',' order by g.field, g.id) as changes, count(*) as n
from {LATEST.replace(') x where', ') x where')} g join {P} on p.ord = g.photo_id where p.scan_root = '/r1' group by 1, 2""", fx.PENDING, fx.PHOTOS)
def pending_listing(changes, photos):
    latest = library.latest_pending(changes).withColumn("old_value", F.lit(None).cast("string"))
    found = edits.listed(latest, photos.where("scan_root = '/r1'").select(F.col("ord").alias("id"), "filename"))
    text = F.transform("changes", lambda c: F.concat(c["field"], F.lit("="), c["new_value"], F.lit("#"), c["id"].cast("string")))
    return found.select("photo_id", "filename", F.array_join(text, ",").alias("changes"), F.size("changes").cast("long").alias("n"))


@query(f"select count(*) as rows, count(distinct photo_id) as photos from {G} join {P} on p.ord = g.photo_id where not g.committed", fx.PENDING, fx.PHOTOS)
def pending_counts(changes, photos):
    changes = changes.withColumn("old_value", F.lit(None).cast("string"))
    found = edits.listed(changes, photos.select(F.col("ord").alias("id"), "filename"))
    return found.agg(F.coalesce(F.sum(F.size("changes")), F.lit(0)).alias("rows"), F.count("*").alias("photos"))


@query(f"select id, committed, 'ids' as how from {G} where id % 3 <> 1 union all select id, committed, 'all' from {G} where committed", fx.PENDING)
def pending_discard(changes):
    some = edits.discarded(changes, changes.where("id % 3 = 1").select("id")).select("id", "committed", F.lit("ids").alias("how"))
    return some.unionByName(edits.discarded(changes).select("id", "committed", F.lit("all").alias("how")))


@query(f"select g.id, p.filename as path, g.field from {G} join {P} on p.ord = g.photo_id where not g.committed and g.id in (3, 5, 9, 10, 11, 501, 502)", fx.PENDING, fx.PHOTOS)
def commit_selected(changes, photos):
    return edits.commit_rows(changes, photos.select(F.col("ord").alias("id"), F.col("filename").alias("path")), [3, 5, 9, 10, 11, 501, 502]).select("id", "path", "field")


RESULTS = "(select distinct user_id as photo_id, user_id % 3 <> 0 as ok from events)"


@query(f"select g.id, g.committed or g.photo_id % 3 <> 0 as committed from {G}", fx.PENDING, RESULTS[1:-1])
def commit_marked(changes, results):
    return edits.committed(changes, results).select("id", "committed")


@query(f"select count(*) filter (where ok) as committed from {RESULTS} r", RESULTS[1:-1])
def commit_count(results):
    return edits.commit_count(results)


EDITS = "(select event_id as id, case when event_id % 3 = 0 then concat('New ', cast(user_id as string)) end as location_name, case when event_id % 4 > 1 then cast(event_id % 4 - 2 as double) end as lat, cast(event_id % 7 as double) as lon, case when event_id % 5 = 0 then '2024-01-01 00:00:00' end as date_taken, event_id % 6 as rotate_degrees from events where event_id % 2 = 0)"
OWN = "(select event_id as id, event_type as location_name, cast(event_id % 90 as double) as lat, cast(null as double) as lon, '2020-02-02 02:02:02' as date_taken, event_type = 'view' as has_gps, 'named' as status from events where event_id % 3 > 0)"
_LIVE = "case when e.lat <> 0 and e.lon <> 0 then 'gps' when coalesce(e.location_name, '') <> '' then 'named' else 'unknown' end"


@query(f"""select e.id as photo_id, f.field, f.old_value, f.new_value from {EDITS} e join {OWN} o on o.id = e.id,
lateral (values ('location_name', o.location_name, e.location_name), ('lat', cast(o.lat as varchar), cast(e.lat as varchar)), ('lon', cast(o.lon as varchar), cast(e.lon as varchar)),
('date_taken', o.date_taken, e.date_taken), ('rotate_degrees', null, cast(nullif(e.rotate_degrees, 0) as varchar))) f(field, old_value, new_value) where f.new_value is not null""", EDITS[1:-1], OWN[1:-1])
def stage_edits(changes, photos):
    return edits.staged_saves(changes, photos)


def _saved(batch):
    date = "o.date_taken" if batch else "case when e.id is not null then e.date_taken else o.date_taken end"
    return f"""select o.id, case when e.id is not null then e.location_name else o.location_name end as location_name, case when e.id is not null then e.lat else o.lat end as lat,
case when e.id is not null then e.lon else o.lon end as lon, {date} as date_taken, case when e.id is not null then coalesce(e.lat <> 0 and e.lon <> 0, false) else o.has_gps end as has_gps,
case when e.id is not null then {_LIVE} else o.status end as status from {OWN} o left join {EDITS} e on e.id = o.id"""


@query(_saved(False), EDITS[1:-1], OWN[1:-1])
def save_live(changes, photos):
    return edits.saved(photos, changes)


@query(_saved(True), EDITS[1:-1], OWN[1:-1])
def save_batch(changes, photos):
    return edits.saved(photos, changes, batch=True)


SETTINGS = "(select concat('k', cast(user_id % 50 as string)) as key, cast(max(event_id) as string) as value, max(event_id) as updated_at from events where event_id % 2 = 0 group by 1)"
NEWER = "(select concat('k', cast(user_id % 70 as string)) as key, cast(event_id as string) as value, event_id as updated_at from events where event_id % 2 = 1)"


@query(f"""with n as (select * from (select *, row_number() over (partition by key order by updated_at desc) as k from {NEWER} x) y where k = 1)
select coalesce(n.key, s.key) as key, coalesce(n.value, s.value) as value, coalesce(n.updated_at, s.updated_at) as updated_at from {SETTINGS} s full outer join n on n.key = s.key""", SETTINGS[1:-1], NEWER[1:-1])
def settings_upsert(rows, more):
    return edits.overwritten(rows, more, "key")


FLAGS = "(select event_id as id, case event_id % 6 when 0 then 'true' when 1 then 'FALSE' when 2 then '0' when 3 then 'Yes' when 4 then '1' end as value, event_id % 4 = 0 as asked from events)"


@query(f"select id, coalesce(lower(value) in ('true', 'yes', '1'), true) or asked as dry_run from {FLAGS} f", FLAGS[1:-1])
def dry_run_gate(rows):
    return rows.select("id", edits.dry_run(F.col("value"), F.col("asked")).alias("dry_run"))


SESSIONS = "(select c_custkey as id, c_name as name, concat('/r', cast(c_custkey % 20 as string)) as scan_root, c_custkey * 7919 % 1009 as last_used from customer)"


@query(f"""select id, name, scan_root, case when id % 3 = 0 then 5000 + id else last_used end as last_used from (select * from {SESSIONS} s union all select id + 100000, trim(concat(' ', name)), scan_root, 1 from {SESSIONS} t where id % 10 = 0) u where id % 7 <> 0""", SESSIONS[1:-1])
def session_crud(sessions):
    blank = F.when(F.col("id") % 10 == 0, F.concat(F.lit(" "), "name")).otherwise("  ")
    new = sessions.select((F.col("id") + 100_000).alias("id"), blank.alias("name"), "scan_root", F.lit(1).cast("long").alias("last_used"))
    everyone = sessions.select("id").union(new.select("id"))
    used = everyone.where("id % 3 = 0").select("id", (F.col("id") + 5000).alias("at"))
    return edits.sessions_after(sessions, new, used, everyone.where("id % 7 = 0"))


TREE = "(select '/r' as scan_root, concat('d', cast(p_partkey % 9 as string), '/', cast(p_partkey as string), '.jpg') as id, concat(cast(p_partkey as string), '.jpg') as filename, case when p_partkey % 4 = 0 then 'first.jpg' end as original_filename, p_partkey as ord from part)"


@query(f"""with w as (select *, regexp_replace(id, '[^/]+$', '') as dir, case ord % 5 when 0 then '' when 1 then 'x' || cast(ord as varchar) || '.jpg' when 2 then 'a/b.jpg' when 3 then cast(ord + 9 as varchar) || '.jpg' else 'same.jpg' end as new_name from {TREE} t where ord % 2 = 0),
g as (select id, dir, new_name, row_number() over (partition by dir, new_name order by ord) as k from w where new_name <> '' and new_name not like '%/%' and dir || new_name not in (select id from {TREE} t))
select case when g.id is not null then g.dir || g.new_name else t.id end as id, case when g.id is not null then g.new_name else t.filename end as filename,
case when g.id is not null then coalesce(t.original_filename, t.filename) else t.original_filename end as original_filename, t.ord from {TREE} t left join g on g.id = t.id and k = 1""", TREE[1:-1])
def rename_applied(photos):
    o = F.col("ord").cast("string")
    name = F.when(F.col("ord") % 5 == 0, " ").when(F.col("ord") % 5 == 1, F.concat(F.lit("x"), o, F.lit(".jpg"))).when(F.col("ord") % 5 == 2, "a/b.jpg").when(F.col("ord") % 5 == 3, F.concat((F.col("ord") + 9).cast("string"), F.lit(".jpg"))).otherwise("same.jpg")
    items = photos.where("ord % 2 = 0").select("ord", "scan_root", "id", name.alias("new_name"))
    return renames.renamed(photos, items).photos.select("id", "filename", "original_filename", "ord")


@query(f"""with t as (select ord, ord // 9 % 4 as place, ord % 9 % 2 = 0 as down, (select max(ord) from {TREE} m) as top from {TREE} t),
w as (select ord, down or place = 3 or ord + 9 > top as ok, case when place = 3 then 'x' || cast(ord as varchar) else cast(ord + 9 as varchar) end || '.jpg' as name from t)
select ord, ok, false as skipped, case when not ok then 'name taken' end as error, case when ok then 'd' || cast(ord % 9 as varchar) || '/' || name end as new_id from w""", TREE[1:-1])
def rename_chains(photos):
    """Fours of files that all move up by one: in some folders from the last one on, so that each name is free in time, in others from the first on."""
    place, o = F.expr("ord div 9 % 4"), F.col("ord")
    name = F.concat(F.when(place == 3, F.concat(F.lit("x"), o)).otherwise((o + 9).cast("string")), F.lit(".jpg"))
    turn = F.when(o % 9 % 2 == 0, 1_000_000_000 - o).otherwise(o)
    items = photos.select((turn * 10 + o % 9).alias("turn"), "scan_root", "id", name.alias("new_name"), "ord")
    got = renames.renamed(photos, items.select(F.col("turn").alias("ord"), "scan_root", "id", "new_name"))
    return got.results.withColumnRenamed("ord", "turn").join(items.select("turn", "ord").hint("merge"), "turn").select("ord", "ok", "skipped", "error", "new_id")


MOVES = "(select p_partkey % 40 as folder, p_partkey as ord, case p_partkey % 3 when 0 then 'a.jpg' when 1 then 'b' else concat('a (', cast(p_partkey % 11 as string), ').jpg') end as filename from part)"
TAKEN = "(select p_partkey % 40 as folder, case when p_partkey % 2 = 0 then 'a.jpg' else 'b (2)' end as filename from part where p_partkey < 30)"


@query(f"""with m as (select m.*, row_number() over (partition by folder, filename order by ord) - 1 as k from {MOVES} m),
f as (select m.*, k + case when (m.folder, m.filename) in (select (folder, filename) from {TAKEN} t) then 1 else 0 end as r,
             case when filename = 'b' then 'b' else regexp_replace(filename, '[.]jpg$', '') end as stem, case when filename = 'b' then '' else '.jpg' end as ext from m),
held as (select distinct folder, filename from {MOVES} m union select folder, filename from {TAKEN} t),
n as (select f.folder, f.ord, f.filename, f.stem, f.ext, f.r, g.n, row_number() over (partition by f.folder, f.ord order by g.n) as j from f, (select unnest(range(1, 200)) as n) g
      where f.r > 0 and not exists (select 1 from held h where h.folder = f.folder and h.filename = f.stem || ' (' || cast(g.n as varchar) || ')' || f.ext)),
x as (select folder, ord, filename as target from f where r = 0 union all select folder, ord, stem || ' (' || cast(n as varchar) || ')' || ext from n where j = r)
select folder, ord, target, regexp_replace(target, '[.]jpg$', '') || '.xmp' as sidecar_target from x""", MOVES[1:-1], TAKEN[1:-1])
def move_plan(files, taken):
    return edits.move_plan(files, taken).select("folder", "ord", "target", "sidecar_target")


@query(f"select p.id as key, 'photo' as kind from {P} where p.ord % 5 <> 0 union all select cast(c.id as varchar), 'change' from {C} join {P} on p.id = c.photo_id where p.ord % 5 <> 0", fx.PHOTOS, fx.COORDS)
def moved_away(photos, coords):
    left, changes = edits.moved(photos, coords, photos.where("ord % 5 = 0").select("id"))
    return left.select(F.col("id").alias("key"), F.lit("photo").alias("kind")).union(changes.select(F.col("id").cast("string"), F.lit("change")))


TIMES = "(select event_id as id, case when event_id % 3 = 0 then ts end as own, cast(event_id * 1000 as double) as modified, cast(event_id * 999 + 500 as double) as changed from events)"


@query(f"select id, cast(coalesce(own, make_timestamp(cast(least(modified, changed) * 1000000 as bigint))) as varchar) as date_taken, case when own is not null then 'exif' else 'filesystem' end as date_source from {TIMES} t", TIMES[1:-1])
def scan_dates(rows):
    found = exprs.taken(F.col("own"), F.col("modified"), F.col("changed"))
    return rows.select("id", found["date_taken"].cast("string").alias("date_taken"), found["date_source"].alias("date_source"))


NUMBERS = "(select l_orderkey, l_linenumber, cast(l_extendedprice as double) / power(10, l_orderkey % 14) * case when l_linenumber % 2 = 0 then -1 else 1 end as x from lineitem)"


@query(f"select l_orderkey, l_linenumber, printf('%g', x) as text from {NUMBERS} n", NUMBERS[1:-1])
def number_text(rows):
    return rows.select("l_orderkey", "l_linenumber", exprs.plain_number(F.col("x")).alias("text"))


NAMED = "(select p_partkey as id, concat('IMG', cast(p_partkey as string), case p_partkey % 5 when 0 then '.JPG' when 1 then '.jpeg' when 2 then '.nef' when 3 then '.DNG' else '' end) as filename from part)"


@query(f"select id, case when lower(filename) like '%.jpg' or lower(filename) like '%.jpeg' then 'exif' else 'sidecar' end as writer from {NAMED} n", NAMED[1:-1])
def writer_dispatch(files):
    return files.select("id", sinks.writer(F.col("filename")).alias("writer"))


@query(f"select to_json({{'id': p.id, 'status': p.status, 'location_name': p.location_name, 'ord': p.ord}}) as json from {P}", fx.PHOTOS)
def listing_json(photos):
    return sinks.as_json(photos.select("id", "status", "location_name", "ord")).select(F.col("json"))


@query(f"""with x as (select ord, location_name, lat, lon, abs(lat) as a, abs(lon) as o from {P}), y as (select *, (a - floor(a)) * 60 as am, (o - floor(o)) * 60 as om from x)
select ord, nullif(location_name, '') as tag_description,
cast(floor(a) as bigint) || '/1,' || cast(floor(am) as bigint) || '/1,' || cast(round_even((am - floor(am)) * 60 * 100, 0) as bigint) || '/100' as tag_lat, case when lat >= 0 then 'N' when lat < 0 then 'S' end as tag_lat_ref,
cast(floor(o) as bigint) || '/1,' || cast(floor(om) as bigint) || '/1,' || cast(round_even((om - floor(om)) * 60 * 100, 0) as bigint) || '/100' as tag_lon, case when lon >= 0 then 'E' when lon < 0 then 'W' end as tag_lon_ref from y""", fx.PHOTOS)
def jpeg_payload(photos):
    return sinks.jpeg_payload(photos).select("ord", "tag_description", "tag_lat", "tag_lat_ref", "tag_lon", "tag_lon_ref")


_PARTS = "cast(floor({x}) as bigint) + cast(floor(({x} - floor({x})) * 60) as bigint) / 60.0 + round_even((({x} - floor({x})) * 60 - floor(({x} - floor({x})) * 60)) * 6000, 0) / 360000.0"


@query(f"""select ord, ord % 97 <> 5 as ok, case when ord % 97 <> 5 then nullif(location_name, '') end as location_name, 'CAM' || lpad(cast(ord % 50 as varchar), 4, '0') as camera,
case when ord % 97 <> 5 then cast(date_trunc('second', date_taken) as varchar) end as date_taken, case when ord % 97 <> 5 then round(sign(lat) * ({_PARTS.format(x='abs(lat)')}), 6) end as lat,
case when ord % 97 <> 5 then round(sign(lon) * ({_PARTS.format(x='abs(lon)')}), 6) end as lon from {P}""", fx.PHOTOS)
def exif_written(photos):
    """Every photo's place and date written into a file's bytes and read back; one file in 97 has a block that can't be read and is refused."""
    whole = jpeg.sample_jpeg(F.format_string("CAM%04d", F.col("ord") % 50))
    # a second entry is announced that the block has no room for: readers still find the first one
    broken = F.concat(F.expr("substring(c, 1, 20)"), F.unhex(F.lit("ff00")), F.expr("substring(c, 23)"))
    photos = photos.select("ord", "location_name", "lat", "lon", "date_taken").repartition("ord")  # a small table is read in few tasks
    files = sinks.jpeg_payload(photos).withColumn("c", whole).withColumn("content", F.when(F.col("ord") % 97 == 5, broken).otherwise(F.col("c"))).drop("c")
    out = jpeg.written(files.select("ord", "content", *jpeg.PAYLOAD)).select(F.col("ord").cast("string").alias("id"), "content", "ord", "ok")
    found = readers.described(readers.metadata(out, ["ord", "ok"]), ["ord", "ok"])  # one pass: files are written once
    return found.select("ord", "ok", "location_name", "camera", F.col("date_taken").cast("string").alias("date_taken"), F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query(f"select ord from {P} where (contains(lower(filename), 'city 1') or contains(lower(folder), 'city 1') or contains(lower(coalesce(location_name, '')), 'city 1')) and status = 'gps'", fx.PHOTOS)
def search_photos(photos):
    return listings.search(photos, "City 1", "gps").select("ord")


@query(f"select id, status from {P} where ord in (2, 4, 8, 16, 32, 64, 900)", fx.PHOTOS)
def photos_by_ids(photos):
    return listings.by_ids(photos, [2, 4, 8, 16, 32, 64, 900], "ord").select("id", "status")


_DATES = "(select event_id as id, case when event_id % 9 > 0 then cast(cast(ts as date) as string) end as date_taken from events)"


@query(f"select * from {_DATES} d order by date_taken nulls first, id limit 1500", _DATES[1:-1])
def listing_by_date(rows):
    return listings.ordered(rows, "date_taken", 1500)


@query(f"select id, name, last_used from {SESSIONS} s order by last_used desc nulls last, id limit 40", SESSIONS[1:-1])
def sessions_recent(sessions):
    return listings.ordered(sessions, "recent", 40).select("id", "name", "last_used")


@query(f"select id, name from {SESSIONS} s order by name desc, id limit 40", SESSIONS[1:-1])
def sessions_by_name(sessions):
    return listings.ordered(sessions, "name_desc", 40).select("id", "name")


@query("select event_id as id, value as timestamp_epoch from events order by value, event_id limit 300", "select event_id as id, value as timestamp_epoch from events")
def points_by_time(points):
    return listings.ordered(points, "points", 300)


@query(f"select name, lat, lon from {GAZETTEER} z where contains(lower(name), 'town 1') order by length(name), name, lat, lon limit 5", GAZETTEER)
def geocode_candidates(places):
    return listings.found_places(places, "Town 1")


@query(f"select distinct split_part(folder, '/', 1) as name, '/r1' as parent from {P} where scan_root = '/r1'", fx.PHOTOS)
def folder_listing(photos):
    hidden = photos.limit(1).select(F.lit("/r1/.hidden/x").alias("path"))
    return listings.subfolders(photos.select(F.concat("scan_root", F.lit("/"), "folder").alias("path")).union(hidden), "/r1/")


@query("select event_id as id from events order by event_id desc limit 500", "select event_id as id from events")
def log_tail_last(log):
    return library.log_tail(log, 0)
