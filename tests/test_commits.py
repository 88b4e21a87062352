import pytest
from pyspark.sql import functions as F
from test_files import file_with
from test_library import tiff

from shutterlake.sources import commits, readers

CHANGE = "id long, photo_id string, field string, new_value string, committed boolean"
PHOTO = "id string, scan_root string, folder string, filename string, original_filename string, path string"


def library_at(root):
    for d in ("x", "_duplicates/x"):
        (root / d).mkdir(parents=True)
    for name in ("a.jpg", "b.jpg", "c.jpg", "dup.jpg", "bad.jpg"):
        (root / "x" / name).write_bytes(file_with(tiff()) + name.encode() if name != "bad.jpg" else b"broken")
    (root / "x" / "raw.nef").write_bytes(b"raw")
    (root / "x" / "dup.xmp").write_text("beside")
    (root / "_duplicates" / "x" / "dup.jpg").write_bytes(b"before")
    names = ("a.jpg", "b.jpg", "c.jpg", "dup.jpg", "bad.jpg", "raw.nef", "lost.jpg")
    photos = [(f"x/{n}", str(root), "x", n, None, f"{root}/x/{n}") for n in names]
    fields = [("a.jpg", "rename", "b.jpg"), ("b.jpg", "rename", "c.jpg"), ("c.jpg", "rename", "d.jpg"), ("c.jpg", "location_name", "Here"), ("c.jpg", "rotate_degrees", "450"), ("dup.jpg", "move_to_duplicates", "1"), ("dup.jpg", "rename", "never.jpg"), ("bad.jpg", "lat", "1"), ("bad.jpg", "lon", "1"), ("bad.jpg", "rename", "good.jpg"), ("raw.nef", "location_name", "R & D"), ("raw.nef", "rename", "dup.nef"), ("lost.jpg", "location_name", "L"), ("a.jpg", "date_taken", "2024-01-02 03:04:05")]
    # names are freed from the last one on
    order = {"c.jpg": 0, "b.jpg": 1, "a.jpg": 2}
    changes = [(100 * order.get(n, 5) + k, f"x/{n}", f, v, False) for k, (n, f, v) in enumerate(fields)] + [(999, "x/a.jpg", "lat", "9", True)]
    return photos, changes


def state(root):
    return {str(p.relative_to(root)): p.read_bytes() for p in sorted(root.rglob("*")) if p.is_file() and not p.name.endswith(".crc")}


def run(spark, root, journal, rows, name="run"):
    photos, changes = rows
    return commits.committed(spark, spark.createDataFrame(changes, CHANGE), spark.createDataFrame(photos, PHOTO), f"file://{journal}", name, turn=lambda data, degrees: data + b"%d" % degrees)


def told(got):
    marks = sorted((r.id, r.committed) for r in got.changes.collect())
    return {r.photo_id: (r.ok, (r.error or "").split(":")[0]) for r in got.results.collect()}, marks, sorted((r.id, r.original_filename, r.filename) for r in got.photos.collect())


WANT = {"x/a.jpg": (True, ""), "x/b.jpg": (True, ""), "x/c.jpg": (True, ""), "x/dup.jpg": (True, ""), "x/bad.jpg": (False, "Unreadable"), "x/raw.nef": (True, ""), "x/lost.jpg": (False, "FileNotFoundError")}


def test_a_commit_and_one_that_is_killed_at_every_step(spark, tmp_path, monkeypatch):
    rows = library_at(tmp_path / "r")
    got = told(run(spark, tmp_path / "r", tmp_path / "j", rows))
    files = state(tmp_path / "r")
    assert got[0] == WANT
    tags = lambda name: readers.tiff_tags(readers.tiff_block(files[name]))
    assert tags("x/d.jpg")["description"] == "Here" and files["x/d.jpg"].endswith(b"c.jpg90") and tags("x/b.jpg")["original"] == "2024:01:02 03:04:05" and files["x/c.jpg"].endswith(b"b.jpg")
    assert b"R &amp; D" in files["x/dup.xmp"] and files["_duplicates/x/dup (1).xmp"] == b"beside" and files["_duplicates/x/dup.jpg"] == b"before" and files["x/bad.jpg"] == b"broken"
    assert set(files) == {"x/b.jpg", "x/c.jpg", "x/d.jpg", "x/bad.jpg", "x/dup.nef", "x/dup.xmp", "_duplicates/x/dup.jpg", "_duplicates/x/dup (1).jpg", "_duplicates/x/dup (1).xmp"}
    assert ("x/d.jpg", "c.jpg", "d.jpg") in got[2] and not [i for i, *_ in got[2] if "dup.jpg" in i]
    assert {c for i, c in got[1] if i in (2, 3, 4)} == {True} and [c for i, c in got[1] if 507 <= i <= 509] == [False] * 3
    assert told(run(spark, tmp_path / "r", tmp_path / "j", rows)) == got and state(tmp_path / "r") == files  # once more: nothing

    once, n = commits.Journal.once, 0
    for stop in ("written", "renames_away", "renames_home"):
        n += 1
        root, journal = tmp_path / f"r{n}", tmp_path / f"j{n}"
        again = library_at(root)

        def killed(self, name, build, stop=stop):
            if name == stop and not self.has(name):
                build().collect()  # all has been done, but no mark was left
                raise KeyboardInterrupt
            return once(self, name, build)

        monkeypatch.setattr(commits.Journal, "once", killed)
        with pytest.raises(KeyboardInterrupt):
            run(spark, root, journal, again)
        monkeypatch.setattr(commits.Journal, "once", once)
        assert told(run(spark, root, journal, again)) == got and state(root) == files, stop


def test_plan_only_and_no_changes(spark, tmp_path):
    photos, changes = library_at(tmp_path / "r")
    plan = commits.plan_of(spark.createDataFrame(changes, CHANGE), spark.createDataFrame(photos, PHOTO).withColumn("lat", F.lit(1)), [2, 505])
    assert {tuple(r) for r in plan.collect()} == {("x/c.jpg", False, False, False, True), ("x/dup.jpg", True, False, False, False)}
    before = state(tmp_path / "r")
    got = told(run(spark, tmp_path / "r", tmp_path / "j", (photos, changes[-1:])))
    assert got[0] == {} and len(got[2]) == 7 and state(tmp_path / "r") == before
