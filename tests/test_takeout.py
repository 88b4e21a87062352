import json
import random

import pytest

from shutterlake.sources import readers, takeout


def document(seed, many):
    """Records with nested objects, other lists of objects, quotes, backslashes and brackets in strings."""
    rng = random.Random(seed)
    odd = lambda: "".join(rng.choice(['"', "\\", "{", "}", "[", "]", ":", "a", "é", "\U0001f600", " "]) for _ in range(rng.randrange(12)))
    record = lambda k: {"timestamp": f"2024-01-01T00:{k // 60 % 60:02d}:{k % 60:02d}Z", "note": odd(), "latitudeE7": k, "longitudeE7": -k, "activity": [{"timestamp": odd(), "type": [{"latitudeE7": 1}]}], odd(): {"locations": [{"timestamp": "x", "latitudeE7": 1, "longitudeE7": 1}]}}
    rows = [record(k) for k in range(many)]
    for bad in ({"timestamp": "2024-01-01T00:00:00Z", "latitudeE7": 1}, {"latitudeE7": 1, "longitudeE7": 2}, {"timestamp": "bad", "latitudeE7": 1, "longitudeE7": 1}, {"timestamp": None, "latitudeE7": 1, "longitudeE7": 1}):
        rows.insert(rng.randrange(len(rows) + 1), bad)
    head, tail = {odd() + "h": [record(900_000)], "locations2": {"a": record(3), "b": [record(4)]}, "s": "locations"}, {"more": [[record(5)], record(6)], "o": record(7)}
    return {**head, "locations": rows, **tail}


@pytest.mark.parametrize("piece,indent,ascii_", [(1, None, True), (37, None, False), (64, 2, True), (1000, 1, False), (1 << 20, None, True)])
def test_pieces_give_the_same_records(piece, indent, ascii_):
    """Without Spark: the states of pieces by the sums, then each piece's records."""
    data = json.dumps(document(piece, 8 if piece < 10 else 40), indent=indent, ensure_ascii=ascii_).encode()

    class File:
        def __init__(self, at):
            self.at = at

        def read(self, n):
            self.at += n
            return data[self.at - n : self.at]

    quotes = depth = 0
    key, bracket, got = None, "", []
    for start in range(0, len(data), piece):
        own, before = data[start : start + piece], data[max(0, start - 4096) : start]
        row = {"path": "p", "start": start, "size": len(own), "in_string": quotes % 2, "depth": depth, "key": key, "bracket": bracket}
        (*_, odd, out, in_), = takeout._counts(None, row, own, before)
        (*_, k, b), = takeout._roots(File(start + len(own)), row, own, before)
        got += takeout._items("locations")(File(start + len(own)), row, own, before)
        quotes, depth = quotes + odd, depth + (in_ if quotes % 2 else out)
        key, bracket = k if k is not None else key, b if b is not None else bracket
    want = [(r["timestamp"], r["latitudeE7"] / 1e7, r["longitudeE7"] / 1e7) for r in json.loads(data)["locations"] if None not in (r.get("timestamp"), r.get("latitudeE7"), r.get("longitudeE7"))]
    assert got == want and depth == 0 and quotes % 2 == 0


def test_one_file_in_several_tasks(spark, tmp_path):
    for name, many in (("a", 300), ("b", 3)):
        (tmp_path / f"{name}.json").write_text(json.dumps(document(many, many), ensure_ascii=False))
    (tmp_path / "empty.json").write_text("")
    rows = takeout.records(spark, str(tmp_path), piece=5000)
    assert rows.rdd.getNumPartitions() > 5
    plain = lambda df: sorted(map(tuple, df.collect()))
    assert plain(readers._points(rows, "timestamp", rows.lat, rows.lon)) == plain(readers.takeout(spark, str(tmp_path / "[ab].json"))) and rows.count() == 305


def test_a_file_that_breaks_off_raises(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"locations": [{"timestamp": "2024-01-01T00:00:00Z", "latitudeE7": 1')
    with pytest.raises(Exception, match="has no end"):
        takeout.records(spark, str(tmp_path / "a.json")).collect()
