"""Location histories in JSON, read by many tasks: one large file is cut at any byte.

What a byte means hangs on all bytes before it: whether it is in a string, how deep it lies,
and under which key of the document. Each is found for all pieces at once. A piece's count of quotes turns the
state at its end whatever it was at its start, so sums over earlier pieces say whether it begins
in a string; its change of depth is then known, and sums say how deep it begins; then
its keys. With that each task reads the records that begin in its piece, to their ends behind it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PIECE = 8 << 20
#: Bytes read behind a piece at first, for keys and records that begin in it.
TAIL = 1 << 16
QUOTE, BACKSLASH = ord('"'), ord("\\")


class Structure:
    """Quotes, brackets outside strings and their depths in some bytes, which begin in a string or not, at a depth."""

    def __init__(self, data: bytes, in_string: bool = False, depth: int = 0, before: bytes = b""):
        b = np.frombuffer(data, np.uint8)
        quotes = np.flatnonzero(b == QUOTE)
        after = b[np.maximum(quotes - 1, 0)] == BACKSLASH
        after[quotes == 0] = before.endswith(b"\\")
        self.quotes = quotes[[not (a and self._escaped(data, int(q), before)) for q, a in zip(quotes, after, strict=True)]] if after.any() else quotes
        self.data, self.in_string = data, in_string
        places = np.flatnonzero((b == 123) | (b == 125) | (b == 91) | (b == 93))
        inside = (np.searchsorted(self.quotes, places) + in_string) % 2 == 1
        self.inner, places = places[inside], places[~inside]
        self.places, self.kinds = places, b[places]
        self.step = np.where((self.kinds == 123) | (self.kinds == 91), 1, -1)
        self.after = depth + np.cumsum(self.step)
        self.depth = depth

    @staticmethod
    def _escaped(data: bytes, at: int, before: bytes) -> bool:
        n, k = 0, at - 1
        while k >= 0 and data[k] == BACKSLASH:
            n, k = n + 1, k - 1
        if k < 0:
            n += len(before) - len(before.rstrip(b"\\"))
        return n % 2 == 1

    def changes(self) -> tuple[int, int]:
        """How the depth changes, if the bytes begin outside and if they begin inside a string."""
        b = np.frombuffer(self.data, np.uint8)
        kinds = b[self.inner]
        return int(self.step.sum()), int(np.where((kinds == 123) | (kinds == 91), 1, -1).sum())

    def events(self, end: int) -> list[tuple[int, str, str]]:
        """(place, "key" or "open", the key or the bracket) of what begins before ``end`` right below the document's root."""
        found = [(int(p), "open", chr(k)) for p, k, a, s in zip(self.places, self.kinds, self.after, self.step, strict=True) if a == 2 and s == 1 and p < end] if (self.after == 2).any() else []
        first = 1 if self.in_string else 0
        opening = self.quotes[first::2]
        at = np.searchsorted(self.places, opening)
        depth = np.concatenate([[self.depth], self.after])[at]
        for k in np.flatnonzero((depth == 1) & (opening < end)):
            q = int(opening[k])
            close = self.quotes[first + 2 * k + 1] if first + 2 * k + 1 < len(self.quotes) else None
            if close is not None and self.data[close + 1 : close + 65].lstrip()[:1] == b":":
                found.append((q, "key", self.data[q + 1 : close].decode("utf-8", "replace")))
        return sorted(found)

    def records(self, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Where objects begin right below something below the root, before ``end``, and the bytes behind their ends; -1 where an end isn't there."""
        begin = self.places[(self.after == 3) & (self.step == 1) & (self.kinds == 123)]
        close = self.places[(self.after == 2) & (self.step == -1) & (self.kinds == 125)]
        begin = begin[begin < end]
        at = np.searchsorted(close, begin)
        return begin, np.where(at < len(close), close[np.minimum(at, len(close) - 1)] + 1, -1) if len(close) else np.full(len(begin), -1)


def _reader(path: str):
    from .sinks import opened

    store, at = opened(path.replace("file:///", "/") if path.startswith("file:///") else path.replace("file:/", "/"))
    return store.open_input_file(at)


def _pieces(columns: dict[str, pa.DataType], work: Callable[..., Iterator[tuple]]):
    """For mapInArrow: the rows that ``work`` makes of each piece: it gets the open file, the piece's row, its bytes and some before."""
    schema = pa.schema(list(columns.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with _reader(row["path"]) as file:
                    back = min(row["start"], 4096)
                    file.seek(row["start"] - back)
                    data = file.read(back + row["size"])
                    for some in _batched(work(file, row, data[back:], data[:back])):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), schema.types, strict=True)], schema=schema)

    return run


def _batched(rows: Iterator[tuple], many: int = 5000) -> Iterator[list[tuple]]:
    some: list[tuple] = []
    for row in rows:
        some.append(row)
        if len(some) == many:
            yield some
            some = []
    if some:
        yield some


def _counts(file, row: dict, data: bytes, before: bytes):
    found = Structure(data, before=before)
    yield (row["path"], row["start"], row["size"], len(found.quotes) % 2, *found.changes())


def _roots(file, row: dict, data: bytes, before: bytes):
    """The last key below the root, and the bracket after it, as far as the piece has them."""
    found = Structure(data + file.read(TAIL), bool(row["in_string"]), row["depth"], before)
    key = bracket = None
    for _, kind, text in found.events(len(data)):
        key, bracket = (text, "") if kind == "key" else (key, text)
    yield (row["path"], row["start"], row["size"], row["in_string"], row["depth"], key, bracket)


def _items(name: str):
    def items(file, row: dict, data: bytes, before: bytes):
        tail, more = file.read(TAIL), TAIL
        while True:
            found = Structure(data + tail, bool(row["in_string"]), row["depth"], before)
            begin, end = found.records(len(data))
            if not len(end) or end[-1] >= 0:
                break
            more *= 4  # the last record goes on
            next_ = file.read(more)
            if not next_:
                raise ValueError(f"{row['path']}: a record that begins at byte {row['start'] + begin[-1]} has no end")
            tail += next_
        events = [(-1, "key", row["key"]), (-1, "open", row["bracket"]), *found.events(len(data))]
        key, bracket, k = None, "", 0
        for b, e in zip(begin.tolist(), end.tolist(), strict=True):
            while k < len(events) and events[k][0] < b:
                key, bracket = (events[k][2], "") if events[k][1] == "key" else (key, events[k][2])
                k += 1
            if key == name and bracket == "[":
                yield from _point(json.loads(found.data[b:e]))

    return items


def _point(record: dict):
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
    lat, lon = record.get("latitudeE7"), record.get("longitudeE7")
    if record.get("timestamp") is not None and number(lat) and number(lon):
        yield str(record["timestamp"]), lat / 1e7, lon / 1e7


def records(spark: SparkSession, path: str, piece: int = PIECE) -> DataFrame:
    """timestamp, lat, lon of the records in the root's array ``locations`` of the JSON files at ``path``, in pieces of ``piece`` bytes.

    Records without a time or without numbers for both coordinates are left out. A file that isn't
    JSON raises. Files are read three times: for quotes, for keys, for records.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    pieces = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(piece).cast("long"))).alias("start"))
    pieces = pieces.select("path", "start", F.least(F.lit(piece).cast("long"), F.col("length") - F.col("start")).alias("size"))
    many = max(1, min(10_000, pieces.count()))
    deal = lambda df: df.repartition(many, "path", "start")
    text, long = pa.string(), pa.int64()
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    sum_ = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    first = deal(pieces).mapInArrow(_pieces({"path": text, "start": long, "size": long, "odd": long, "out": long, "in": long}, _counts), "path string, start long, size long, odd long, out long, `in` long")
    first = first.withColumn("in_string", sum_("odd") % 2)
    first = first.withColumn("depth", sum_(F.when(F.col("in_string") == 0, F.col("out")).otherwise(F.col("in"))))
    state = {"path": text, "start": long, "size": long, "in_string": long, "depth": long}
    roots = deal(first.select(*state)).mapInArrow(_pieces(state | {"key": text, "bracket": text}, _roots), "path string, start long, size long, in_string long, depth long, key string, bracket string")
    last = lambda c: F.last(c, ignorenulls=True).over(before)
    roots = roots.select(*state, last("key").alias("key"), F.coalesce(last("bracket"), F.lit("")).alias("bracket"))
    return deal(roots).mapInArrow(_pieces({"timestamp": text, "lat": pa.float64(), "lon": pa.float64()}, _items("locations")), "timestamp string, lat double, lon double")
