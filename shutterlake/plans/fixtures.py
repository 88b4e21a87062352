"""Photo-shaped views over the test tables, as SQL that Spark and DuckDB both run."""

PHOTOS = """
select concat('/r', cast(user_id % 20 as string)) as scan_root,
       concat('f', cast(user_id % 7 as string), '/IMG_', cast(event_id as string), '.jpg') as id,
       concat('IMG_', cast(event_id as string), '.jpg') as filename,
       concat('f', cast(user_id % 7 as string)) as folder,
       event_id as ord, ts as date_taken,
       case when event_type='error' then 'filesystem' else 'exif' end as date_source,
       event_type='view' as has_gps,
       case when event_type='view' then cast(event_id*7919 % 180000 as double)/1000 - 90 end as lat,
       case when event_type='view' then cast(event_id*104729 % 360000 as double)/1000 - 180 end as lon,
       case when event_type='signup' then concat('Place ', cast(user_id % 12 as string))
            when event_type='view' and event_id % 3 = 0 then concat('City ', cast(user_id % 12 as string)) end as location_name,
       case when event_type='view' then 'gps' when event_type='signup' then 'named' else 'unknown' end as status
from events"""
COORDS = f"""
select ord*2 as id, id as photo_id, 'lat' as field, case when ord % 100 = 0 then 'bad' else cast(ord % 90 as string) end as new_value, ord % 7 = 3 as committed
from ({PHOTOS}) p where ord % 10 in (0,1)
union all
select ord*2+1, id, 'lon', cast(ord % 180 as string), ord % 7 = 3 or ord % 40 = 30 from ({PHOTOS}) p where ord % 10 in (0,2)"""
PENDING = """
select event_id as id, user_id as photo_id,
       case event_type when 'view' then 'lat' when 'click' then 'lon' when 'signup' then 'location_name' when 'purchase' then 'date_taken' else 'rename' end as field,
       cast(value as string) as new_value, event_id % 4 = 0 as committed
from events"""
FILES = """
select p_partkey as ord,
       concat('IMG_', cast(p_partkey % 700 as string),
              case when p_partkey % 3 = 0 then concat(' (', cast(p_partkey % 5 + 1 as string), ')') else '' end,
              case when p_partkey % 2 = 0 then '.JPG' else '.jpg' end) as filename
from part"""
HASHED = "select doc_id as ord, md5(text) as file_hash from documents"
DMS = """
select l_orderkey, l_linenumber, cast(l_quantity as double) as d, cast(l_linenumber as double) as m, cast(l_discount as double)*100 as s,
       case when l_returnflag in ('A') then 'S' else 'N' end as ref
from lineitem"""
OLD = """
select doc_id as id, case when doc_id % 11 = 0 then 'OLYMPUS DIGITAL CAMERA' when doc_id % 13 = 0 then '' when doc_id % 7 < 4 then concat('Old ', source) end as location_name,
       case doc_id % 5 when 0 then 'named' when 1 then 'gps' when 2 then 'history' when 3 then 'inferred' else 'unknown' end as status
from documents where doc_id % 3 <> 0"""
NEW = """
select doc_id as id, case when doc_id % 17 < 5 then concat('New ', lang) end as location_name,
       case when doc_id % 19 < 6 then 'gps' when doc_id % 17 < 5 then 'named' else 'unknown' end as status
from documents where doc_id % 4 <> 0"""
PHASHES = """
select v.vec_id as id, b.p0 ^ (shiftleft(1L, int(4*(v.vec_id % 4))) - 1) as phash
from embeddings v join (select vec_id, aggregate(transform(sequence(0,63), i -> if(embedding[i] > 0, shiftleft(1L,i), 0L)), 0L, (a,b) -> a|b) as p0 from embeddings) b
  on b.vec_id = v.vec_id - v.vec_id % 4"""
PHASHES_DUCKDB = """
select v.vec_id as id, xor(b.p0, ((1::ubigint << (4*(v.vec_id % 4))::int) - 1)::ubigint) as phash
from embeddings v join (select vec_id, list_sum(list_transform(range(64), lambda i: case when embedding[i+1] > 0 then 1::ubigint << i::int else 0::ubigint end))::ubigint as p0 from embeddings) b
  on b.vec_id = v.vec_id - v.vec_id % 4"""
