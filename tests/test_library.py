import json
import random
import struct
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shutterlake.functions import exprs
from shutterlake.operators import components, dedup, library, temporal
from shutterlake.plans import catalogue, edits  # noqa: F401
from shutterlake.sources import readers
from shutterlake.streaming.ingest import stream_into_library


def test_each_query_has_an_oracle():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)


def nearest(target, sources, tolerance):
    """(delta, later?, tie) least; sources in stored order."""
    best = None
    for order, us in sources:
        d = abs(us - target)
        key = (d, us >= target, -order if us < target else order)
        if d <= tolerance and (best is None or key < best[0]):
            best = (key, order)
    return best and best[1]


@pytest.mark.parametrize(("seed", "block"), [(1, 4096), (2, 19)])
def test_nearest_joins_equal_a_sequential_search(spark, monkeypatch, seed, block):
    monkeypatch.setattr(temporal, "BLOCK", block)
    rng = random.Random(seed)
    zero = datetime(2024, 1, 1)
    rows = [(rng.choice("ab"), i, zero + timedelta(seconds=rng.randrange(4000)), rng.random() < 0.4) for i in range(300)]
    rows += [("c", 900, zero, False)]
    photos = spark.createDataFrame(rows, "root string, ord long, t timestamp_ntz, src boolean").withColumn("target", ~F.col("src"))
    near = temporal.nearest_in_group(photos.withColumn("p", F.col("ord")), "root", "t", "ord", "src", "target", 60_000_000, ["p"])
    got = {r.ord: r.near_p for r in near.collect()}
    us = lambda t: int((t - zero).total_seconds() * 1e6)
    want = {o: n for r, o, t, s in rows if not s and (n := nearest(us(t), [(p, us(x)) for q, p, x, y in rows if y and q == r], 60_000_000)) is not None}
    assert got == want
    points = photos.where("src").select(temporal.micros(F.col("t")).alias("us"), "ord", F.col("ord").alias("p"))
    probes = photos.where("target").select("ord", temporal.micros(F.col("t")).alias("us"))
    got = {r.ord: r.near_p for r in temporal.nearest_overall(probes, points, 7_000_000, ["p"]).collect()}
    assert got == {o: n for _, o, t, s in rows if not s and (n := nearest(us(t), [(p, us(x)) for _, p, x, y in rows if y], 7_000_000)) is not None}


def test_stars_equal_the_greedy_walk(spark):
    rng = random.Random(5)
    hashes = [(i, rng.choice([0, 0b1111, 0b11111111, 0b111111111111, 0x7FFF, -1, -2]) ^ rng.choice([0, 1 << 62])) for i in range(60)] + [(60, None)]
    rows = spark.createDataFrame([(i, p, None if i % 5 else p) for i, p in hashes], "id long, phash bigint, dhash bigint")
    pairs = {(r.a, r.b) for r in dedup.hamming_pairs(rows).collect()}
    bits = lambda x: bin(x & (2**64 - 1)).count("1")
    want = {(i, j) for i, p in hashes for j, q in hashes if i < j and p is not None and q is not None and bits(p ^ q) <= 10}
    assert pairs == want
    seed_of, used = {}, set()
    for i, _ in hashes:
        if i not in used:
            for j, _ in hashes:
                if j > i and j not in used and (i, j) in want:
                    seed_of[j] = i
                    used.add(j)
            used.add(i)
    assert {r.member: r.seed for r in dedup.stars(spark.createDataFrame(sorted(want), "a long, b long")).collect()} == seed_of


def greedy(pairs):
    near, seed_of = {}, {}
    for a, b in pairs:
        near.setdefault(b, set()).add(a)
        near.setdefault(a, set())
    for b in sorted(near):
        seeds = [a for a in near[b] if a not in seed_of]
        if seeds:
            seed_of[b] = min(seeds)
    return seed_of


@pytest.mark.parametrize(("walk", "chunk"), [(1_000_000, 1_000_000), (3, 1)])
def test_stars_of_chains_and_random_graphs(spark, monkeypatch, walk, chunk):
    monkeypatch.setattr(dedup, "WALK_EDGES", walk)
    monkeypatch.setattr(components, "CHUNK", chunk)
    rng = random.Random(walk)
    pairs = {(i, i + 1) for i in range(1000 if walk > 3 else 12)}  # a burst: each picture near the next
    pairs |= {tuple(sorted(rng.sample(range(2000, 2060), 2))) for _ in range(60)} | {(3000, 3000 + k) for k in range(1, 40)}
    rows = spark.createDataFrame([*sorted(pairs), (0, 1)], "a long, b long").repartition(5)
    assert {r.member: r.seed for r in dedup.stars(rows).collect()} == greedy(pairs)
    assert dedup.stars(rows.limit(0)).collect() == []


def test_components_equal_union_find(spark, monkeypatch):
    monkeypatch.setattr(components, "CHUNK", 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        rng = random.Random(4)
        ids = rng.sample(range(10_000), 64)
        pairs = [(ids[i], ids[i + 1]) for i in range(40)] + [tuple(rng.sample(ids[42:], 2)) for _ in range(12)]
        root = {i: i for p in pairs for i in p}
        for _ in root:
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
        found = components.roots(spark.createDataFrame(pairs, "a long, b long").repartition(6))
        assert {r.id: r.root for r in found.df.collect()} == {i: r for i, r in root.items() if i != r}
        found.drop()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_bands_lose_no_near_hash(spark):
    rng = random.Random(8)
    turn = lambda h, n: h ^ sum(1 << i for i in rng.sample(range(64), n))
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    for bits in (3, dedup.DHASH_BITS, dedup.PHASH_BITS):
        pairs = [(signed(h), signed(turn(h, bits))) for h in (rng.getrandbits(64) for _ in range(500))]
        shared = spark.createDataFrame(pairs, "h long, g long").where(F.arrays_overlap(dedup.bands(F.col("h"), bits), dedup.bands(F.col("g"), bits)))
        assert shared.count() == 500
    with pytest.raises(ValueError):
        dedup.bands(F.col("h"), 12)


def test_keys_of_near_hashes_are_not_broadcast(spark):
    rows = spark.range(400).select("id", F.xxhash64("id").alias("phash"), F.xxhash64(F.col("id") + 1000).alias("dhash"))
    links = dedup.class_links(dedup.classes(rows))
    links.collect()
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_perceptual_groups_with_copies_equal_the_greedy_walk(spark):
    rng = random.Random(6)
    pick = lambda: rng.choice([0, 0b1111, 0b11111111, 0x7FFF, -1, None, 1 << 40]) if rng.random() < 0.8 else rng.getrandbits(62)
    rows = [(i, pick(), pick()) for i in range(150)] + [(200 + i, 77 << 20, None) for i in range(400)]
    bits = lambda x, y: 99 if x is None or y is None else bin((x ^ y) & (2**64 - 1)).count("1")
    want, used = {}, set()
    for i, p, d in rows:
        if i in used or (p is None and d is None):
            continue
        found = [(j, bits(p, q), bits(d, e)) for j, q, e in rows if j > i and j not in used]
        found = [(j, a, b) for j, a, b in found if a <= dedup.PHASH_BITS or b <= dedup.DHASH_BITS]
        if found:
            want[i] = (i, 100, "seed")
        for j, a, b in found:
            want[j] = (i, round((1 - min(a, b) / 64) * 100), "dhash" if b < a else "phash")
            used.add(j)
    got = dedup.perceptual(spark.createDataFrame(rows, "id long, phash bigint, dhash bigint")).collect()
    assert len(got) == len(want)
    assert {r.member: (r.seed, r.similarity, r.match_on) for r in got} == want


def test_scalars(spark):
    row = spark.range(1).select(
        exprs.minutes(F.lit(30_000_000)).alias("a"), exprs.minutes(F.lit(90_000_000)).alias("b"), exprs.minutes(F.lit(210_000_000)).alias("c"),
        exprs.hash_value(F.lit("ffffffffffffffff")).alias("top"), exprs.hash_value(F.lit("zz")).alias("bad"), exprs.hamming(F.lit(-1), F.lit(0)).alias("all"), exprs.hamming(F.lit(None).cast("bigint"), F.lit(0)).alias("none"),
        exprs.tolerance_minutes(F.lit("x")).alias("t1"), exprs.tolerance_minutes(F.lit("0")).alias("t2"), exprs.duplicate_base(F.lit("A (1)(2).jpg")).alias("base"), exprs.duplicate_base(F.lit("noext (1)")).alias("same"),
        exprs.exif_date(F.lit("bad"), F.lit("2020:01:01 00:00:00")).alias("date"), exprs.rotation(F.lit(-90), F.lit(".JPG")).alias("turn"), exprs.rational(F.lit(1), F.lit(0)).alias("den"),
    ).first()
    assert tuple(row) == (0, 2, 4, -1, None, 64, 99, 60, 1, "a (1).jpg", "noext (1)", None, 270, None)


def test_staging_supersedes_and_renames_collide(spark):
    old = spark.createDataFrame([(1, "p", "lat", "1", False), (2, "p", "lat", "0", True), (3, "q", "lat", "5", False)], "id long, photo_id string, field string, new_value string, committed boolean")
    more = spark.createDataFrame([(4, "p", "lat", None, False)], old.schema)
    assert sorted(r.id for r in library.staged(old, more).collect()) == [2, 3, 4]
    plan = spark.createDataFrame([("f", "a.jpg", "c.jpg"), ("f", "b.jpg", "c.jpg"), ("f", "d.jpg", ""), ("g", "a.jpg", "x/y.jpg")], "folder string, filename string, new_name string")
    assert {(r.filename, r.folder): (r.valid, r.collision) for r in library.rename_plan(plan).collect()} == {("a.jpg", "f"): (True, True), ("b.jpg", "f"): (True, True), ("d.jpg", "f"): (False, False), ("a.jpg", "g"): (False, False)}


def tiff():
    """A TIFF block with a model, a date and a position."""
    model, date = b"X100\0", b"2021:05:06 07:08:09\0"
    place = struct.pack("<6I", 10, 1, 30, 1, 0, 1)
    at = 8 + 42 + 54
    main = struct.pack("<HHHII", 3, 0x0110, 2, len(model), at) + struct.pack("<HHII", 0x0132, 2, len(date), at + 8) + struct.pack("<HHII", 0x8825, 4, 1, 8 + 2 + 36 + 4)
    gps = struct.pack("<H", 4) + b"".join([struct.pack("<HHI4s", 1, 2, 2, b"S\0\0\0"), struct.pack("<HHII", 2, 5, 3, 200), struct.pack("<HHI4s", 3, 2, 2, b"E\0\0\0"), struct.pack("<HHII", 4, 5, 3, 200)]) + b"\0" * 4
    data = b"II*\0" + struct.pack("<I", 8) + main + b"\0" * 4 + gps
    main_at = at
    data = data.ljust(main_at, b"\0") + model.ljust(8, b"\0") + date
    return data.ljust(200, b"\0") + place


def test_files(spark, tmp_path):
    (tmp_path / "a" / "_duplicates").mkdir(parents=True)
    block = b"Exif\0\0" + tiff()
    (tmp_path / "a" / "one.JPG").write_bytes(b"\xff\xd8\xff\xe1" + struct.pack(">H", len(block) + 2) + block + b"\xff\xda")
    (tmp_path / "a" / "_duplicates" / "two.jpg").write_bytes(b"x")
    (tmp_path / "three.txt").write_bytes(b"x")
    (tmp_path / "broken.nef").write_bytes(b"II*\0")
    files = readers.photo_files(spark, str(tmp_path))
    assert sorted(r.id for r in files.select("id").collect()) == ["a/one.JPG", "broken.nef"]
    rows = {r.id: r for r in readers.described(readers.metadata(files)).collect()}
    assert rows["a/one.JPG"].camera == "X100" and rows["a/one.JPG"].date_taken == datetime(2021, 5, 6, 7, 8, 9)
    assert (rows["a/one.JPG"].lat, rows["a/one.JPG"].lon) == (-10.5, 10.5) and not rows["broken.nef"].has_gps


def test_histories(spark, tmp_path):
    records = [{"timestamp": "2024-01-01T00:00:01Z", "latitudeE7": 10, "longitudeE7": 20, "activity": [{"timestamp": "x"}]}, {"timestamp": "2024-01-01T00:00:02Z"}, {"timestamp": "bad", "latitudeE7": 1, "longitudeE7": 1}]
    (tmp_path / "h.json").write_text(json.dumps({"locations": records}))
    (tmp_path / "t.gpx").write_text('<gpx xmlns="u"><trk><trkseg><trkpt lat="1.5" lon="2"><time>2024-01-01T00:00:03.5Z</time></trkpt><trkpt lat="1"><time>2024-01-01T00:00:00Z</time></trkpt><trkpt lat="1" lon="1"/></trkseg></trk></gpx>')
    target = str(tmp_path / "points")
    assert readers.import_points(spark, str(tmp_path / "h.json"), 1, target) == "google_takeout"
    assert readers.import_points(spark, str(tmp_path / "t.gpx"), 2, target) == "gpx"
    zero = 1704067200_000000
    assert sorted((r.import_id, r.us - zero, r.lat, r.lon) for r in spark.read.parquet(target).collect()) == [(1, 1_000_000, 1e-6, 2e-6), (2, 3_500_000, 1.5, 2.0)]


def test_stream(spark, tmp_path):
    schema = "id long, location_name string, status string"
    incoming = str(tmp_path / "in")
    for batch in ([(1, "A", "named"), (2, None, "unknown")], [(1, None, "unknown"), (3, None, "gps")]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(incoming)
        stream_into_library(spark, incoming, schema, str(tmp_path / "lib"), str(tmp_path / "check")).awaitTermination(60)
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "lib")).drop("bucket").collect()} == {(1, "A", "named"), (2, None, "unknown"), (3, None, "gps")}
