import random

import pytest
from pyspark.sql import functions as F

from shutterlake.operators import renames

PHOTO, ITEM = "scan_root string, id string, filename string, original_filename string, path string, n long", "ord long, scan_root string, id string, new_name string"


def simulated(photos, items, taken=(), sidecars=()):
    """One after the other, on a dict of paths."""
    at = {f"{r}/{i}": n for n, (r, i) in enumerate(photos)}
    names, results = {n: (r, i, None) for n, (r, i) in enumerate(photos)}, []
    for k, root, key, name in sorted(items):
        s, name = f"{root}/{key}", (name or "").strip()
        if s not in at:
            results.append((k, False, False, "not found", None))
        elif not name or name == key.split("/")[-1]:
            results.append((k, True, True, None, None))
        elif "/" in name or "\\" in name:
            results.append((k, False, False, "invalid name", None))
        else:
            t = s[: s.rfind("/") + 1] + name
            if t in at or t in taken:
                results.append((k, False, False, "name taken", None))
                continue
            n = at.pop(s)
            at[t] = n
            names[n] = (root, t[len(root) + 1 :], names[n][2] or key.split("/")[-1])
            results.append((k, True, False, None, t[len(root) + 1 :]))
    return results, {(n, *names[n]) for n in names}


def compared(spark, photos, items, taken=()):
    rows = [(r, i, i.split("/")[-1], None, f"{r}/{i}", n) for n, (r, i) in enumerate(photos)]
    got = renames.renamed(spark.createDataFrame(rows, PHOTO), spark.createDataFrame(items, ITEM), spark.createDataFrame([(t,) for t in taken], "path string"))
    results, names = simulated(photos, items, taken)
    assert sorted((r.ord, r.ok, r.skipped, r.error, r.new_id) for r in got.results.collect()) == results
    after = got.photos.collect()
    assert {(r.n, r.scan_root, r.id, r.original_filename) for r in after} == {(n, r, i, o) for n, r, i, o in names}
    assert all(r.path == f"{r.scan_root}/{r.id}" and r.filename == r.id.split("/")[-1] for r in after)
    assert got.log.count() == sum(r[4] is not None for r in results)
    return got


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equal_to_one_after_the_other(spark, seed):
    """Few names in few folders: chains, circles, several items for one photo or one name, photos renamed twice."""
    rng = random.Random(seed)
    name = lambda: rng.choice([f"{rng.randrange(12)}.jpg"] * 9 + [" ", "a/b.jpg", None, " 3.jpg "])
    photos = sorted({(f"/r{rng.randrange(2)}", f"{d}{rng.randrange(12)}.jpg") for d in ("", "x/", "y/") for _ in range(9)})
    items = [(k, f"/r{rng.randrange(2)}", f"{rng.choice(['', 'x/', 'y/'])}{rng.randrange(12)}.jpg", name()) for k in rng.sample(range(1000), 70)]
    compared(spark, photos, items, ["/r0/5.jpg", "/r1/x/7.jpg", "/r0/y/0.jpg"])


def test_long_chains_and_circles(spark):
    n = 300
    photos = [("/r", f"IMG_{k}.jpg") for k in range(n)] + [("/r", f"c{k}.jpg") for k in range(5)]
    up = [(n - k, "/r", f"IMG_{k}.jpg", f"IMG_{k + 1}.jpg") for k in range(n)]
    circle = [(1000 + k, "/r", f"c{k}.jpg", f"c{(k + 1) % 5}.jpg") for k in range(5)]
    got = compared(spark, photos, up + circle)
    assert got.results.where("ok").count() == n and got.moves.count() == n
    down = [(k, "/r", f"IMG_{k}.jpg", f"IMG_{k + 1}.jpg") for k in range(n)]
    assert compared(spark, photos, down).results.where("ok").count() == 1


def test_many_for_one_name_and_one_photo_often(spark):
    photos = [("/r", f"{k}.jpg") for k in range(40)]
    same = [(k, "/r", f"{k}.jpg", "same.jpg") for k in range(40)]
    again = [(100 + k, "/r", "same.jpg" if k == 0 else f"t{k - 1}.jpg", f"t{k}.jpg") for k in range(40)]
    got = compared(spark, photos, same + again)
    assert [(r.old_path, r.new_path) for r in got.moves.collect()] == [("/r/0.jpg", "/r/t39.jpg")]


def test_sidecars_go_with_their_photos(spark):
    rows = [("/r", i, i, None, f"/r/{i}", 0) for i in ("a.jpg", "a.nef", "b.jpg", "c.jpg")]
    items = [(1, "/r", "c.jpg", "d.jpg"), (2, "/r", "b.jpg", "c.jpg"), (3, "/r", "a.nef", "e.nef"), (4, "/r", "a.jpg", "f.jpg")]
    sidecars = spark.createDataFrame([("/r/a.xmp",), ("/r/b.xmp",)], "path string")
    got = renames.renamed(spark.createDataFrame(rows, PHOTO), spark.createDataFrame(items, ITEM), None, sidecars)
    assert {r.old_path: (r.sidecar_from, r.sidecar_to) for r in got.moves.collect()} == {"/r/c.jpg": (None, None), "/r/b.jpg": ("/r/b.xmp", "/r/c.xmp"), "/r/a.nef": ("/r/a.xmp", "/r/e.xmp"), "/r/a.jpg": (None, None)}


def test_no_items_and_other_columns(spark):
    photos = spark.createDataFrame([("/r", "a.jpg", "a.jpg", None, "/r/a.jpg", 1)], PHOTO).withColumn("k", F.lit(7))
    got = renames.renamed(photos, spark.createDataFrame([], ITEM))
    assert got.photos.collect()[0].k == 7 and got.results.count() == got.log.count() == got.moves.count() == 0


def test_no_table_of_items_is_broadcast(spark):
    photos = spark.createDataFrame([("/r", f"{k}.jpg", f"{k}.jpg", None, f"/r/{k}.jpg", k) for k in range(3)], PHOTO)
    got = renames.renamed(photos, spark.createDataFrame([(1, "/r", "2.jpg", "3.jpg"), (2, "/r", "1.jpg", "2.jpg")], ITEM))
    assert {(r.n, r.id) for r in got.photos.collect()} == {(0, "0.jpg"), (1, "2.jpg"), (2, "3.jpg")}
    plan = got.photos._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "Broadcast" not in plan
