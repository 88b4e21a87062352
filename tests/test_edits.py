import base64
import json
import random
import re
import struct
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from shutterlake.functions import exprs
from shutterlake.operators import edits, inference, listings, ranking, scratch, temporal
from shutterlake.plans import edits as plans
from shutterlake.sources import encode, images, readers, sinks
from shutterlake.streaming.ingest import Progress, stream_into_library


def test_numbers_have_six_digits(spark):
    values = [1234.5678, 1e-7, 1e6, 0.0, 999999.5, 0.00012345678, -2.5, 19336.25, 95611.45, 5.6, 100.0, 1e-5, 123456789.0, 0.1 + 0.2]
    got = [r.t for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(exprs.plain_number(F.col("v")).alias("t")).collect()]
    assert got == [f"{v:g}" for v in values]


def test_ranks_in_parts_equal_plain_ranks(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(10**6)) for _ in range(3000)]
    rows = [(k, o) for o, k in {o: k for k, o in rows}.items()] + [("b", None)]
    got = {(r.k, r.o): r.n for r in ranking.numbered(spark.createDataFrame(rows, "k string, o long"), ["k"], "o", "n", part_rows=100).collect()}
    want = {}
    for key in ("a", "b", None):
        want |= {(key, o): n for n, o in enumerate(sorted((o for k, o in rows if k == key), key=lambda o: -1 if o is None else o), 1)}
    assert got == want


def test_nearest_where_one_group_and_one_moment_hold_most_rows(spark):
    rng = random.Random(3)
    zero = datetime(2024, 1, 1)
    rows = [("hot", i, datetime.fromtimestamp(zero.timestamp() + rng.choice([0, 0, 0, 5, 90, 4000])), rng.random() < 0.5) for i in range(500)] + [(None, 900, zero, False), ("hot", 901, None, False)]
    photos = spark.createDataFrame(rows, "root string, ord long, t timestamp_ntz, src boolean").withColumns({"target": ~F.col("src"), "p": F.col("ord")})
    near = temporal.nearest_in_group(photos, "root", "t", "ord", "src", "target", 80_000_000, ["p"])
    got = {r.ord: r.near_p for r in near.collect()}
    want = {}
    for root, o, t, s in rows:
        if not s and root and t:
            best = min(((abs(d := (x - t).total_seconds()), d >= 0, -p if d < 0 else p, p) for q, p, x, y in rows if y and q == root), default=None)
            if best and best[0] <= 80:
                want[o] = best[3]
    assert got == want


def blocks(h, w):
    """A picture of 15 x 20 patches."""
    return np.kron(np.random.default_rng(4).integers(0, 230, (15, 20, 3)), np.ones((h // 15, w // 20, 1))).astype(np.uint8)


def test_pictures_are_hashed_and_scaled(spark, tmp_path):
    a = blocks(300, 400)
    noise = np.random.default_rng(1).integers(0, 255, (200, 200, 3)).astype(np.uint8)
    for name, rgb in (("a.jpg", a), ("small.jpg", blocks(75, 100)), ("light.jpg", np.clip(a.astype(int) + 20, 0, 255).astype(np.uint8)), ("noise.jpg", noise)):
        (tmp_path / name).write_bytes(images.png(rgb))
    (tmp_path / "broken.jpg").write_bytes(b"no picture")
    files = readers.photo_files(spark, str(tmp_path)).drop("content")
    rows = {r.filename: r for r in images.photos_with_hashes(files, images.pictures(spark, str(tmp_path))).collect()}
    assert len(rows) == 5 and rows["broken.jpg"].phash is None and len(rows["a.jpg"].phash) == 16
    apart = lambda x, y, h: bin(int(rows[x][h], 16) ^ int(rows[y][h], 16)).count("1")
    assert apart("a.jpg", "small.jpg", "phash") <= 10 and apart("a.jpg", "light.jpg", "dhash") <= 8
    assert apart("a.jpg", "noise.jpg", "phash") > 10 and apart("a.jpg", "noise.jpg", "dhash") > 8
    thumbs = {r.path.rsplit("/", 1)[1]: r.thumbnail for r in images.thumbnails(images.pictures(spark, str(tmp_path)), 100).collect()}
    raw = base64.b64decode(thumbs["a.jpg"])
    assert thumbs["broken.jpg"] is None and raw[:2] == b"\xff\xd8" and struct.unpack(">HH", raw[raw.index(b"\xff\xc0") + 5 :][:4]) == (75, 100)


def test_encoded_pictures_are_read_back(spark, tmp_path):
    rng = np.random.default_rng(3)
    y, x = np.mgrid[0:61, 0:83]
    smooth = np.stack([x * 3 % 256, y * 4 % 256, (x + y) % 256], axis=2).astype(np.uint8)
    made = {
        "flat": np.full((16, 24, 3), (200, 30, 90), np.uint8), "dot": np.full((1, 1, 3), 7, np.uint8), "smooth": smooth // 2 + 40,
        "noise": rng.integers(0, 256, (37, 50, 3)).astype(np.uint8), "edges": np.where((x // 9 + y // 7) % 2, 255, 0)[:, :, None].repeat(3, 2).astype(np.uint8),
        "rows": np.tile(np.where(np.arange(40) % 2, 255, 0)[:, None, None], (1, 9, 3)).astype(np.uint8),
    }
    for name, rgb in made.items():
        for quality in (75, 100):
            (tmp_path / f"{name}{quality}.jpg").write_bytes(encode.jpeg(rgb, quality))
    for r in images.pictures(spark, str(tmp_path)).collect():
        name, quality = re.fullmatch(r".*/([a-z]+)(\d+)\.jpg", r.path).groups()
        got, want = images.pixels(r.height, r.width, r.channels, r.data).astype(int), made[name].astype(int)
        assert got.shape == want.shape
        error = np.abs(got - want).mean()
        assert error < (1.2 if quality == "100" else 40 if name == "noise" else 8), (name, quality, error)
    for bad in (0, 101):
        with pytest.raises(ValueError):
            encode.jpeg(made["dot"], bad)


def test_code_lengths_are_bound_and_leave_one_code_free():
    for counts in ({5: 1}, {s: 2**s for s in range(40)}, {s: 1 for s in range(162)}):
        lengths = encode.code_lengths(counts)
        assert set(lengths) == set(counts) and 1 <= min(lengths.values()) and max(lengths.values()) <= 16
        assert sum(2.0**-n for n in lengths.values()) < 1


def test_the_dry_run_gate_and_sidecars(spark, tmp_path):
    photos = spark.createDataFrame([("a.nef", f"{tmp_path}/a.nef", "Here & <there>", 1.5, -2.0, "2024"), ("b.jpg", f"{tmp_path}/b.jpg", None, None, None, None)], "filename string, path string, location_name string, lat double, lon double, date_taken string")
    settings = spark.createDataFrame([("dry_run", "false")], "key string, value string")
    assert edits.is_dry_run(settings.limit(0)) and not edits.is_dry_run(settings) and edits.is_dry_run(settings, True)
    staged = sinks.write_sidecars(photos, settings, asked=True).collect()
    assert [r.path for r in staged] == [f"{tmp_path}/a.xmp"] and list(tmp_path.iterdir()) == []
    assert sinks.write_sidecars(photos, settings) is None
    assert "Here &amp; &lt;there&gt;" in (tmp_path / "a.xmp").read_text() and not (tmp_path / "b.xmp").exists()
    assert json.loads(sinks.as_json(photos).where("json like '%b.jpg%'").first().json)["lat"] is None


def test_lookups_ask_once_for_each_neighbour(spark, tmp_path):
    calls = tmp_path / "calls"

    def ask(lat, lon):
        with calls.open("a") as f:
            f.write(f"{lat} {lon}\n")
        return f"at {lat:g}" if lat else None

    schema = "id string, ord long, scan_root string, filename string, date_taken timestamp_ntz, has_gps boolean, lat double, lon double, status string, location_name string"
    at = lambda s: datetime(2024, 1, 1, 0, 0, s)
    rows = [("s", 1, "r", "s.jpg", at(0), True, 5.0, 6.0, "gps", "")] + [(f"t{k}", 10 + k, "r", "t.jpg", at(k + 1), False, None, None, "unknown", "kept" if k else None) for k in range(5)]
    rows += [("z", 30, "q", "z.jpg", at(0), True, 0.0, 1.0, "gps", None), ("u", 31, "q", "u.jpg", at(3), False, None, None, "unknown", "own"), ("p", 32, "r", "p.jpg", at(3), False, None, None, "unknown", None)]
    pending = spark.createDataFrame([(1, "p", "lat", "9")], "id long, photo_id string, field string, new_value string")
    got = {r.id: r for r in inference.inferred(spark.createDataFrame(rows, schema), pending, inference.remote(ask, gap=0.0)).collect()}
    assert all(got[f"t{k}"].location_name == "at 5" and got[f"t{k}"].status == "inferred" and got[f"t{k}"].inferred_from == "s.jpg" for k in range(5))
    assert (got["u"].location_name, got["u"].inferred_lat) == ("own", 0.0) and got["p"].status == "unknown" and got["s"].status == "gps"
    assert len(calls.read_text().splitlines()) == 2


def test_moves_never_meet(spark):
    files = spark.createDataFrame([("f", n, i) for i, n in enumerate(["a.jpg"] * 4 + ["a (1).jpg", "a (3).jpg", "a (1).jpg", "b", "b"])], "folder string, filename string, ord int")
    taken = spark.createDataFrame([("f", "a.jpg"), ("f", "b (1)"), ("g", "b")], "folder string, filename string")
    for have in (None, taken):
        rows = edits.move_plan(files, have).orderBy("ord").collect()
        names = [r.target for r in rows]
        assert len(set(names)) == len(names) and not (have is not None and {"a.jpg", "b (1)"} & set(names))
    assert names[:4] == ["a (2).jpg", "a (4).jpg", "a (5).jpg", "a (6).jpg"] and names[-2:] == ["b", "b (2)"]


def test_orders(spark):
    rows = spark.createDataFrame([(1, None), (2, "b"), (3, "a")], "id long, name string")
    assert [r.id for r in listings.ordered(rows, "name").collect()] == [1, 3, 2]
    assert [r.id for r in listings.ordered(rows, "name_desc").collect()] == [2, 3, 1]
    same = spark.createDataFrame([(3, "b"), (1, "b"), (2, "b"), (4, "c"), (0, None)], "id long, name string")
    assert [r.id for r in listings.ordered(same, "name_desc", 2).collect()] == [4, 1]
    recent = same.select("id", F.length("name").alias("last_used"))
    assert [r.id for r in listings.ordered(recent, "recent").collect()] == [1, 2, 3, 4, 0]
    places = spark.createDataFrame([(3, 1), (1, 2)], "id long, place int")
    assert [r.id for r in listings.custom(rows, places).collect()] == [3, 1, 2]


def test_prompts_meet_only_photos_of_near_numbers(spark):
    rows = [(f"i{k}", k, "f", f"{k}.jpg", "/r10", k in (51, 59, 60, 110, 111, 119, 120), None) for k in range(50, 130)]
    photos = spark.createDataFrame(rows, "id string, ord long, folder string, filename string, scan_root string, has_gps boolean, location_name string")
    out = plans.suggestion_prompt(photos)
    got = {r.ord: re.findall(r"  - (\d+)\.jpg", r.prompt) for r in out.collect()}
    assert got == {50: ["51", "59", "60", "110"], 100: []}
    joins = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line]
    assert len(joins) == 1 and joins[0].count(" = ") == 2  # root and stretch


def test_folders_of_one_machine_are_refused_on_a_cluster(spark):
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(RuntimeError):
        scratch.shared_dir(Session())
    with scratch.scratch() as kept:
        gone, stays = (scratch.Stored(spark.range(3), "t") for _ in range(2))
        kept.append(stays)
    assert stays.df.count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FILE_NOT_EXIST"):
        spark.read.parquet(gone.path).count()
    stays.drop()


def test_a_stream_rewrites_only_what_it_touches(spark, tmp_path):
    schema, incoming, library = "id long, location_name string, status string", str(tmp_path / "in"), tmp_path / "lib"
    progress = Progress()
    spark.streams.addListener(progress)
    for batch in ([(k, f"n{k}", "named") for k in range(300)], [(7, None, "unknown"), (400, None, "gps"), (400, "x", "named")]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(incoming)
        before = {p.name: p.stat().st_mtime_ns for p in library.glob("bucket=*/*.parquet")}
        stream_into_library(spark, incoming, schema, str(library), str(tmp_path / "check"), files_per_batch=1).awaitTermination(60)
    same = [n for n, t in before.items() if any(p.name == n and p.stat().st_mtime_ns == t for p in library.glob("bucket=*/*.parquet"))]
    rows = {r.id: (r.location_name, r.status) for r in spark.read.parquet(str(library)).collect()}
    assert len(rows) == 301 and rows[7] == ("n7", "named") and rows[400] == ("x", "named") and len(same) >= len(before) - 2
    spark.streams.removeListener(progress)
    assert sum(rows for _, rows, _ in progress.state.values()) == 303
