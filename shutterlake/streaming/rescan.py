"""A stream of what changes in a photo tree: each batch is a scan, compared with the one before.

An offset is a scan's time. The folders right below the root are listed by one task each;
a listing is kept in the state folder under its folder and scan, so the driver holds
folder names only, and a batch that runs again compares the same two listings.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from shutterlake.functions.exprs import EXTENSIONS
from shutterlake.sources import sinks
from shutterlake.sources.readers import DUPLICATES_FOLDER

NAME = "photo_changes"
SCHEMA = "id string, file_mtime double, size bigint, change string"
#: Times that differ by no more seconds are equal.
TOLERANCE = 1
#: The part of the files that lie in the root itself.
ITSELF = "."

Listing = dict[str, tuple[float, int]]


class Part(InputPartition):
    def __init__(self, folder: str, before: int, now: int):
        self.folder, self.before, self.now = folder, before, now


def _names(at: str) -> list:
    """What lies right below a folder; nothing where there is none."""
    from pyarrow.fs import FileSelector

    store, path = sinks.opened(at)
    return store.get_file_info(FileSelector(path, allow_not_found=True))


def _listed(root: str, folder: str) -> Listing:
    """id -> time and size of the photos of a part."""
    from pyarrow.fs import FileSelector, FileType

    store, base = sinks.opened(root)
    where = base if folder == ITSELF else f"{base}/{folder}"
    out = {}
    for f in store.get_file_info(FileSelector(where, allow_not_found=True, recursive=folder != ITSELF)):
        name = f.path[len(base.rstrip("/")) + 1 :]
        if f.type == FileType.File and name.lower().endswith(tuple(EXTENSIONS)) and DUPLICATES_FOLDER not in name.split("/"):
            out[name] = (f.mtime_ns / 1e9, f.size)
    return out


class Reader(DataSourceStreamReader):
    def __init__(self, root: str, state: str):
        self.root, self.state = root.rstrip("/"), state.rstrip("/")

    def initialOffset(self) -> dict:
        return {"scan": 0}

    def latestOffset(self) -> dict:
        return {"scan": time.time_ns() // 1_000_000}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        """A part for each folder that is there or was."""
        from pyarrow.fs import FileType

        there = {f.base_name for at in (self.root, self.state) for f in _names(at) if f.type == FileType.Directory}
        return [Part(f, start["scan"], end["scan"]) for f in sorted((there | {ITSELF}) - {DUPLICATES_FOLDER, "=root"})]

    def _kept(self, folder: str, scan: int) -> str:
        return f"{self.state}/{'=root' if folder == ITSELF else folder}/{scan}.json"

    def _read(self, folder: str, scan: int) -> Listing | None:
        try:
            return {k: tuple(v) for k, v in json.loads(sinks.content(self._kept(folder, scan))).items()}
        except FileNotFoundError:
            return None

    def read(self, part: Part) -> Iterator[tuple]:
        before = self._read(part.folder, part.before) or {}
        now = self._read(part.folder, part.now)
        if now is None:
            now = _listed(self.root, part.folder)
            at = self._kept(part.folder, part.now)
            store, path = sinks.opened(at)
            store.create_dir(path[: path.rfind("/")])
            sinks.put(at, json.dumps(now).encode())
        for name, (mtime, size) in now.items():
            old = before.get(name)
            if old is None or abs(old[0] - mtime) > TOLERANCE:
                yield (name, mtime, size, "new" if old is None else "changed")
        for name in before.keys() - now.keys():
            yield (name, before[name][0], before[name][1], "vanished")
        self._forget(part)

    def _forget(self, part: Part) -> None:
        """Listings older than the scan before aren't needed any more."""
        at = self._kept(part.folder, 0)
        for f in _names(at[: at.rfind("/")]):
            if f.base_name.removesuffix(".json").isdigit() and int(f.base_name.removesuffix(".json")) < part.before:
                sinks.opened(at)[0].delete_file(f.path)

    def commit(self, end: dict) -> None:
        pass


class PhotoChanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> Reader:
        return Reader(self.options["path"], self.options["state"])


def changes(spark: SparkSession, root: str, state: str) -> DataFrame:
    """A stream of photos below ``root`` (a path that all machines see) that are new, changed (their time by over a second) or vanished since the scan before: id (relative path), file_mtime, size, change.

    Each batch scans once: give the query a trigger with an interval, or
    availableNow for one scan. ``state`` is a shared folder of this stream's own, kept as long as
    its checkpoint. Speculative tasks could keep another listing than they return; leave them off.
    """
    spark.dataSource.register(PhotoChanges)
    return spark.readStream.format(NAME).option("path", root).option("state", state).load()
