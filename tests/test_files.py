import json
import random
import struct
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from test_library import tiff

from shutterlake.plans import edits as plans
from shutterlake.sources import jpeg, readers, sinks


def file_with(block, before=b""):
    body = b"Exif\0\0" + block
    return b"\xff\xd8" + before + b"\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xda\0\x02pixels\xff\xd9"


def maker_block():
    """Big-endian, with a maker's note, a thumbnail directory and a GPS height that nobody here reads."""
    entries = [(0x010F, 2, 6, 200), (0x8769, 4, 1, 80), (0x8825, 4, 1, 120)]
    main = struct.pack(">H", 3) + b"".join(struct.pack(">HHII", *e) for e in entries) + struct.pack(">I", 160)
    exif = struct.pack(">H", 2) + struct.pack(">HHII", 0x9003, 2, 20, 210) + struct.pack(">HHII", 0x927C, 7, 40, 240) + b"\0" * 4
    gps = struct.pack(">H", 1) + struct.pack(">HHII", 6, 5, 1, 290) + b"\0" * 4
    thumbnail = struct.pack(">H", 1) + struct.pack(">HHII", 0x0103, 3, 1, 6 << 16) + b"\0" * 4
    out = bytearray(b"MM\0*" + struct.pack(">I", 8)).ljust(300, b"\0")
    for at, part in ((8, main), (80, exif), (120, gps), (160, thumbnail), (200, b"Maker\0"), (210, b"2020:01:02 03:04:05\0"), (240, bytes(range(40))), (290, struct.pack(">2I", 77, 1))):
        out[at : at + len(part)] = part
    return bytes(out)


def test_tags_are_set_and_others_kept():
    app0 = b"\xff\xe0" + struct.pack(">H", 7) + b"JFIF\0"
    old = file_with(maker_block(), app0)
    new = jpeg.tagged(old, "Zürich & more", "47/1,22/1,3000/100", "N", "8/1,32/1,6000/100", "E", "2024:05:06 07:08:09")
    tags = readers.tiff_tags(readers.tiff_block(new))
    assert tags["description"] == "Zürich & more" and tags["make"] == "Maker" and tags["original"] == tags["date"] == "2024:05:06 07:08:09"
    assert tags["lat"] == [(47, 1), (22, 1), (3000, 100)] and tags["lon_ref"] == "E"
    block = jpeg.Block(readers.tiff_block(new))
    assert block.exif[0x927C] == jpeg.Block(maker_block()).exif[0x927C] and block.data[240:280] == bytes(range(40)) and block.gps[6][1] == 1 and block.next == 160
    assert new.startswith(b"\xff\xd8" + app0) and new.endswith(b"\xff\xda\0\x02pixels\xff\xd9")
    assert jpeg.tagged(new, "Zürich & more", "47/1,22/1,3000/100", "N", "8/1,32/1,6000/100", "E", "2024:05:06 07:08:09") == new
    again = jpeg.tagged(new, None, "1/1,2/1,3/100", "S", "1/1,2/1,3/100", "W", None)
    tags = readers.tiff_tags(readers.tiff_block(again))
    assert tags["lat_ref"] == "S" and tags["description"] == "Zürich & more" and jpeg.Block(readers.tiff_block(again)).next == 160
    assert jpeg.tagged(old, None, None, None, None, None, None) == old
    bare = jpeg.tagged(b"\xff\xd8\xff\xda\0\x02\xff\xd9", "x", None, None, None, None, None)
    assert readers.tiff_tags(readers.tiff_block(bare)) == {"description": "x"}


@pytest.mark.parametrize("change", [lambda b: b[:2] + b"\0\0" + b[4:], lambda b: b[:4] + b"\xff\xff\xff\xff" + b[8:], lambda b: b[:8] + b"\xff\xff" + b[10:], lambda b: b[:30], lambda b: b[:12] + b"\0\x63" + b[14:], lambda b: b[:30] + struct.pack(">I", 8) + b[34:]])
def test_what_cannot_be_read_is_refused(change):
    with pytest.raises(jpeg.Unreadable):
        jpeg.tagged(file_with(change(maker_block())), "x", None, None, None, None, None)


def test_files_without_end_or_room_are_refused():
    for bad in (b"", b"GIF89a", b"\xff\xd8", b"\xff\xd8\xff\xe1\xff\xff", b"\xff\xd8no"):
        with pytest.raises(jpeg.Unreadable):
            jpeg.tagged(bad, "x", None, None, None, None, None)
    with pytest.raises(jpeg.Unreadable):
        jpeg.tagged(file_with(maker_block()), "x" * 70_000, None, None, None, None, None)
    for cut in range(len(maker_block())):  # any beginning of a block is written or refused, nothing else
        try:
            jpeg.tagged(file_with(maker_block()[:cut]), "x", None, None, None, None, None)
        except jpeg.Unreadable:
            pass


def test_written_rows_keep_columns_and_report(spark):
    good, bad = file_with(tiff()), file_with(tiff()[:20])
    rows = [(1, good, "here", 1.25, -2.5, "kept"), (2, bad, "here", 1.0, 1.0, None), (3, None, "x", None, None, None), (4, good, None, 3.0, None, "no place")]
    photos = spark.createDataFrame(rows, "id long, content binary, location_name string, lat double, lon double, error string").withColumn("date_taken", F.lit(None).cast("timestamp_ntz"))
    got = {r.id: r for r in jpeg.written(sinks.jpeg_payload(photos)).collect()}
    assert {k: r.ok for k, r in got.items()} == {1: True, 2: False, 3: False, 4: True} and got[2].error and got[1].error is None
    assert got[2].content == bad and got[3].content is None and got[4].content == good and got[1].location_name == "here"
    tags = readers.described(readers.metadata(spark.createDataFrame([(str(k), r.content) for k, r in got.items()], "id string, content binary"))).where("id = '1'").first()
    assert (tags.lat, tags.lon, tags.location_name, tags.camera, tags.date_taken) == (1.25, -2.5, "here", "X100", datetime(2021, 5, 6, 7, 8, 9))
    assert jpeg.written(sinks.jpeg_payload(photos.limit(0))).collect() == []


def test_files_are_written_once_and_read_in_the_same_pass(spark):
    zero = datetime(2024, 5, 6, 7, 8, 9)
    rows = [(k, "" if k == 1 else f"Place {k}", 1.5 if k % 2 else None, 2.5 if k % 2 else None, zero) for k in (1, 5, 6)]
    out = plans.exif_written(spark.createDataFrame(rows, "ord long, location_name string, lat double, lon double, date_taken timestamp_ntz"))
    day = "2024-05-06 07:08:09"
    assert sorted(map(tuple, out.collect())) == [(1, True, None, "CAM0001", day, 1.5, 2.5), (5, False, None, "CAM0005", None, None, None), (6, True, "Place 6", "CAM0006", day, None, None)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan


def test_tags_in_files(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(file_with(tiff()))
    (tmp_path / "b.jpg").write_bytes(b"no picture")
    rows = [(f"file://{tmp_path}/a.jpg", "a.jpg", "Here", 1.0, 2.0), (f"{tmp_path}/b.jpg", "b.jpg", "Here", 1.0, 2.0), (f"{tmp_path}/gone.jpg", "gone.jpg", "Here", 1.0, 2.0), (f"{tmp_path}/raw.nef", "raw.nef", "Here", 1.0, 2.0)]
    photos = spark.createDataFrame(rows, "path string, filename string, location_name string, lat double, lon double").withColumn("date_taken", F.lit("2024-01-02 03:04:05").cast("timestamp_ntz"))
    live = spark.createDataFrame([("dry_run", "false")], "key string, value string")
    assert sinks.write_tags(photos, live, asked=True).count() == 3 and b"Here" not in (tmp_path / "a.jpg").read_bytes()
    out = {r.path[-6:]: r.ok for r in sinks.write_tags(photos, live).collect()}
    assert out == {"/a.jpg": True, "/b.jpg": False, "ne.jpg": False} and (tmp_path / "b.jpg").read_bytes() == b"no picture"
    assert readers.tiff_tags(readers.tiff_block((tmp_path / "a.jpg").read_bytes()))["original"] == "2024:01:02 03:04:05"
    assert not list(tmp_path.glob("*.part"))
