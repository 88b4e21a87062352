import os

from pyspark.sql import functions as F

from shutterlake.operators import scratch
from shutterlake.plans import files


def test_trees_go_as_the_scan_goes_on(spark, monkeypatch):
    monkeypatch.setattr(files, "TREE_BYTES", 500_000)
    folder = scratch.shared_dir(spark).removeprefix("file://")
    trees = lambda: {f for f in os.listdir(folder) if f.startswith("tree-")}
    before, written, removed = trees(), [], files.removed

    def watched(session, path):
        at = path.removeprefix("file://")
        written.append((len(trees() - before), sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(at) for f in names if not f.startswith("."))))
        removed(session, path)

    monkeypatch.setattr(files, "removed", watched)
    rows = spark.range(120).select(F.col("id").alias("n"), F.concat(F.lit("d"), F.col("id") % 7, F.lit("/p"), "id", F.when(F.col("id") % 4 == 2, ".txt").otherwise(".jpg")).alias("id"), F.lit("x").alias("name"))
    got = files.photo_scan(rows).collect()
    assert {(r.id, r.filename, r.folder, r.size_kb, r.camera) for r in got} == {(f"d{n % 7}/p{n}.jpg", f"p{n}.jpg", f"d{n % 7}", round((50 + n % 3 * 40000) / 1024), f"CAM{n % 50:04d}") for n in range(120) if n % 4 != 2}
    assert len(got) == 90 and trees() == before
    assert len(written) == 10 and all(n == 1 and size < 1_500_000 for n, size in written)


def test_no_pictures_to_scan(spark):
    rows = spark.createDataFrame([], "n long, id string, name string")
    assert files.photo_scan(rows).collect() == []


def test_pictures_of_one_part_are_written_in_several_tasks(spark, monkeypatch):
    assert files._parts(60_000) == 120
    monkeypatch.setattr(files, "_parts", lambda n: 3)
    rows = spark.range(1, 41).select(F.col("id").alias("number"), (F.col("id") * 5).alias("level"), F.lit(9).alias("width"), F.lit(4).alias("height")).coalesce(1)
    out = files.pictures_read_back(rows)
    assert sorted(map(tuple, out.collect())) == [(n, 9, 4, n * 5, n * 5) for n in range(1, 41)]
    assert out.rdd.getNumPartitions() == 3
