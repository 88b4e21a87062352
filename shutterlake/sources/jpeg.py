"""Tags written into JPEG files: bytes in, bytes out.

A file's EXIF block stays as it is: changed directories and new values are put
behind it and its header points to them, so what isn't written keeps its bytes and its
place (makers' notes hold offsets of their own). A block that can't be read through is refused, and
the file's bytes stay what they were.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .readers import SIZES

# Numbers of tags and directories, and the sizes of types that only files have.
DESCRIPTION, DATE, EXIF, GPS, INTEROP, ORIGINAL, ORIENTATION = 0x010E, 0x0132, 0x8769, 0x8825, 0xA005, 0x9003, 0x0112
LAT_REF, LAT, LON_REF, LON = 1, 2, 3, 4
ALL_SIZES = SIZES | {6: 1, 8: 2, 11: 4, 12: 8}
ASCII, SHORT, LONG, RATIONAL = 2, 3, 4, 5
#: Bytes that a segment has room for besides its length and "Exif".
ROOM = 65535 - 2 - 6

Entry = tuple[int, int, bytes]


class Unreadable(ValueError):
    """An EXIF block or a JPEG file that isn't what it should be."""


class Block:
    """A TIFF block's directories, each a dict of tag -> (type, count, the entry's last four bytes)."""

    def __init__(self, data: bytes):
        self.data, self.order = data, {b"II": "<", b"MM": ">"}.get(data[:2], "")
        if not self.order or len(data) < 8 or struct.unpack_from(self.order + "H", data, 2)[0] != 42:
            raise Unreadable("no TIFF header")
        self.seen: set[int] = set()
        (at,) = struct.unpack_from(self.order + "I", data, 4)
        self.main, self.next = self._directory(at)
        self.exif, self.exif_next = self._below(self.main, EXIF)
        self.gps, self.gps_next = self._below(self.main, GPS)
        self._below(self.exif, INTEROP)
        if self.next:  # the thumbnail's
            self._directory(self.next)

    @classmethod
    def empty(cls) -> Block:
        return cls(b"II*\0" + struct.pack("<IHI", 8, 0, 0))

    def _below(self, directory: dict[int, Entry], tag: int) -> tuple[dict[int, Entry], int]:
        if tag not in directory:
            return {}, 0
        return self._directory(struct.unpack(self.order + "I", directory[tag][2])[0])

    def _directory(self, at: int) -> tuple[dict[int, Entry], int]:
        if at in self.seen or at + 2 > len(self.data):
            raise Unreadable(f"a directory at {at} of {len(self.data)} bytes")
        self.seen.add(at)
        (count,) = struct.unpack_from(self.order + "H", self.data, at)
        end = at + 2 + 12 * count
        if end + 4 > len(self.data):
            raise Unreadable(f"a directory of {count} entries at {at} ends behind the block")
        found = {}
        for k in range(count):
            tag, kind, n = struct.unpack_from(self.order + "HHI", self.data, at + 2 + 12 * k)
            raw = self.data[at + 10 + 12 * k : at + 14 + 12 * k]
            size = ALL_SIZES.get(kind)
            if size is None:
                raise Unreadable(f"tag {tag} has the type {kind}")
            if size * n > 4 and struct.unpack(self.order + "I", raw)[0] + size * n > len(self.data):
                raise Unreadable(f"tag {tag} lies behind the block")
            found[tag] = kind, n, raw
        return found, struct.unpack_from(self.order + "I", self.data, end)[0]

    def _has(self, old: dict[int, Entry], kind: int, values, tag: int) -> bool:
        k, n, raw = old.get(tag, (0, 0, b""))
        want = self._packed(kind, values)
        if k != kind or n != (len(want) if kind == ASCII else len(values)):
            return False
        at = struct.unpack(self.order + "I", raw)[0]
        return (raw[: len(want)] if len(want) <= 4 else self.data[at : at + len(want)]) == want

    def _packed(self, kind: int, values) -> bytes:
        if kind == ASCII:
            return values + b"\0"
        flat = [x for v in values for x in v] if kind == RATIONAL else values
        return struct.pack(f"{self.order}{len(flat)}{'H' if kind == SHORT else 'I'}", *flat)

    def with_tags(self, main: dict[int, tuple[int, list]], exif: dict[int, tuple[int, list]], gps: dict[int, tuple[int, list]]) -> bytes:
        """The block with these tags (type, values; text as bytes) set in its directories; one that has them stays as it is."""
        if all(self._has(old, *v, t) for old, new in ((self.main, main), (self.exif, exif), (self.gps, gps)) for t, v in new.items()):
            return self.data
        out = bytearray(self.data)

        def put(raw: bytes) -> int:
            out.extend(b"\0" * (len(out) % 2))
            out.extend(raw)
            return len(out) - len(raw)

        def entry(kind: int, values) -> Entry:
            raw = self._packed(kind, values)
            return kind, len(raw) if kind == ASCII else len(values), raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(self.order + "I", put(raw))

        def directory(old: dict[int, Entry], new: dict[int, Entry], after: int) -> int:
            all_ = sorted((old | new).items())
            return put(struct.pack(self.order + "H", len(all_)) + b"".join(struct.pack(self.order + "HHI", t, k, n) + raw for t, (k, n, raw) in all_) + struct.pack(self.order + "I", after))

        top = {t: entry(*v) for t, v in main.items()}
        for tag, old, new, after in ((EXIF, self.exif, exif, self.exif_next), (GPS, self.gps, gps, self.gps_next)):
            if new:
                top[tag] = entry(LONG, [directory(old, {t: entry(*v) for t, v in new.items()}, after)])
        struct.pack_into(self.order + "I", out, 4, directory(self.main, top, self.next))
        return bytes(out)


def segments(content: bytes) -> Iterator[tuple[int, int, int]]:
    """(marker, start, end) of a JPEG file's segments before its picture."""
    if content[:2] != b"\xff\xd8":
        raise Unreadable("no JPEG file")
    at = 2
    while True:
        while content[at : at + 2] == b"\xff\xff":  # fill bytes
            at += 1
        if at + 4 > len(content) or content[at] != 0xFF:
            raise Unreadable(f"no segment at {at}")
        size = struct.unpack_from(">H", content, at + 2)[0]
        if content[at + 1] in (0xD9, 0xDA):
            return
        if size < 2 or at + 2 + size > len(content):
            raise Unreadable(f"a segment of {size} bytes at {at}")
        yield content[at + 1], at, at + 2 + size
        at += 2 + size


def with_tags(content: bytes, main: dict, exif: dict, gps: dict) -> bytes:
    """A JPEG file with tags set; without an EXIF segment it gets one, as its first."""
    place = next(((a, b) for m, a, b in segments(content) if m == 0xE1 and content[a + 4 : a + 10] == b"Exif\0\0"), None)
    block = Block(content[place[0] + 10 : place[1]]) if place else Block.empty()
    new = block.with_tags(main, exif, gps)
    if len(new) > ROOM:
        raise Unreadable(f"its tags would take {len(new)} bytes, a segment holds {ROOM}")
    segment = b"\xff\xe1" + struct.pack(">H", len(new) + 8) + b"Exif\0\0" + new
    start, end = place or (2, 2)
    return content[:start] + segment + content[end:]


def _degrees(text: str) -> list[tuple[int, int]]:
    return [tuple(map(int, part.split("/"))) for part in text.split(",")]


PAYLOAD = ("tag_description", "tag_lat", "tag_lat_ref", "tag_lon", "tag_lon_ref", "tag_date")


def tagged(content: bytes, description: str | None, lat: str | None, lat_ref: str | None, lon: str | None, lon_ref: str | None, date: str | None) -> bytes:
    """A JPEG file with a payload's tags, those that aren't null; a date is set as the picture's and the file's."""
    main, exif, gps = {}, {}, {}
    if description is not None:
        main[DESCRIPTION] = ASCII, description.encode()
    if date is not None:
        main[DATE] = exif[ORIGINAL] = ASCII, date.encode()
    if lat is not None and lon is not None:
        gps = {LAT_REF: (ASCII, lat_ref.encode()), LAT: (RATIONAL, _degrees(lat)), LON_REF: (ASCII, lon_ref.encode()), LON: (RATIONAL, _degrees(lon))}
    return with_tags(content, main, exif, gps)


def written(files: DataFrame) -> DataFrame:
    """``files`` (content and the columns of ``sinks.jpeg_payload``) with content after writing, ok and error.

    A file that can't be read through, null content too, keeps its content: ok is
    false and error says why. Where the payload is all null, nothing is changed. Other
    columns are kept.
    """
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in files.schema if f.name not in ("ok", "error")]
    names = [f.name for f in files.schema if f.name not in ("ok", "error")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content, ok, error = [], [], []
            payload = zip(*(batch.column(c).to_pylist() for c in PAYLOAD), strict=True)
            for old, tags in zip(batch.column("content").to_pylist(), payload, strict=True):
                new, why = old, None
                try:
                    if old is None:
                        raise Unreadable("no content")
                    new = tagged(old, *tags)
                except (ValueError, struct.error) as e:
                    why = str(e)
                content.append(new)
                ok.append(why is None)
                error.append(why)
            columns = [pa.array(content, pa.binary()) if c == "content" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(ok), pa.array(error, pa.string())], names=[*names, "ok", "error"])

    return files.select(*names).mapInArrow(run, ", ".join([*(f"`{f.split(' ', 1)[0]}` {f.split(' ', 1)[1]}" for f in fields), "ok boolean", "error string"]))


def sample_jpeg(model: F.Column) -> F.Column:
    """Bytes of a JPEG file without a picture whose EXIF block names a camera of seven characters."""
    # header, one directory with one entry (model, text of eight bytes at 26), end of directories
    block = F.concat(F.unhex(F.lit("49492a000800000001001001020008000000" + "1a00000000000000")), model.cast("binary"), F.unhex(F.lit("00")))
    return F.concat(F.unhex(F.lit("ffd8ffe1002a457869660000")), block, F.unhex(F.lit("ffda0002ffd9")))
