"""Commits carried out on files, with a journal that survives a driver or an executor that is lost.

What is to be done is written to the journal before anything is touched: a row for each
action. Actions run in four steps (moves to the folder for duplicates, tags and sidecars,
turns, renames), each one Spark job whose results are its marks in the journal. A run that is
started again with the same name reads its plan from the journal, takes marked steps from
there and repeats the one that broke off; each action can be repeated, so
files and marks end as if nothing had happened.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.functions import exprs
from shutterlake.operators import edits, library, renames

from . import jpeg, sinks
from .readers import DUPLICATES_FOLDER

MARKS = "photo_id string, action string, ok boolean, error string"
#: (bytes of a JPEG file, degrees clockwise) -> bytes.
Turn = Callable[[bytes, int], bytes]


class Journal:
    """Tables of one run below a shared folder; each is there whole or not at all."""

    def __init__(self, spark: SparkSession, folder: str, run: str):
        self.spark, self.at = spark, f"{folder.rstrip('/')}/{run}"

    def has(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.at}/{name}/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """The table ``name``, built and written now unless an earlier start of the run has."""
        if not self.has(name):
            build().write.mode("overwrite").parquet(f"{self.at}/{name}")
        return self.spark.read.parquet(f"{self.at}/{name}")


def moved(source: str, target: str) -> None:
    """A file moved to a name that is free; a move that has been done already counts as done."""
    store, at = sinks.opened(source)
    _, to = sinks.opened(target)
    there, gone = store.get_file_info([to, at])
    if gone.type == fs.FileType.NotFound:
        if there.type == fs.FileType.NotFound:
            raise FileNotFoundError(f"{source} no longer exists")
        return
    if there.type != fs.FileType.NotFound:
        raise FileExistsError(f"{target} already exists")
    store.create_dir(to[: to.rfind("/")])
    store.move(at, to)


def _with_sidecar(source: str, target: str, beside: str | None, beside_target: str | None) -> None:
    moved(source, target)
    if beside and beside_target and (sinks.exists(beside) or sinks.exists(beside_target)):
        moved(beside, beside_target)


def _waiting(path: str, run: str) -> str:
    """A name that a file has between its old and its new one."""
    return f"{path[: path.rfind('/') + 1]}.{run}-{hashlib.md5(path.encode()).hexdigest()}"


def _marks(rows: DataFrame, act: Callable[[dict], None], action: str) -> DataFrame:
    """Acts on each row and gives its mark. What goes wrong with a file is its row's error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            error = []
            for row in batch.to_pylist():
                try:
                    act(row)
                    error.append(None)
                except (OSError, ValueError, struct.error) as e:
                    error.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([batch.column("photo_id"), pa.array([action] * len(error)), pa.array([e is None for e in error]), pa.array(error, pa.string())], names=["photo_id", "action", "ok", "error"])

    return rows.mapInArrow(run, MARKS)


def _probed(paths: DataFrame, look: Callable[[str], Iterator[str]]) -> DataFrame:
    """path: what ``look`` finds for each of ``paths`` (path)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([x for p in batch.column("path").to_pylist() for x in look(p)], pa.string())], names=["path"])

    return paths.select("path").distinct().mapInArrow(run, "path string")


def _itself(path: str) -> Iterator[str]:
    if sinks.exists(path):
        yield path


def _below(path: str) -> Iterator[str]:
    store, at = sinks.opened(path)
    for info in store.get_file_info(fs.FileSelector(at, allow_not_found=True)):
        if info.type == fs.FileType.File:
            yield f"{path}/{info.base_name}"


def _plan(changes: DataFrame, photos: DataFrame, ids: list[int] | None) -> DataFrame:
    """One row for each photo with uncommitted changes: what its fields say, which actions it takes, and its turn (its first change's id)."""
    rows = edits.commit_rows(changes, photos, ids)
    fields = library.pivoted(rows).select("photo_id", "location_name", F.col("lat").alias("lat_text"), F.col("lon").alias("lon_text"), F.col("date_taken").alias("date_text"), F.col("rotate_degrees").alias("turn_text"), F.col("rename").alias("new_name"))
    actions = library.commit_plan(rows).withColumnRenamed("rename", "renames")
    first = rows.groupBy("photo_id").agg(F.min("id").alias("turn"))
    own = photos.select(F.col("id").alias("photo_id"), "scan_root", "folder", "filename", "path")
    value = lambda c, kind: F.nullif(F.col(c), F.lit("")).try_cast(kind)
    bad = F.array_compact(F.array(*(F.when(~exprs.blank(F.col(c)) & value(c, kind).isNull(), F.concat(F.lit("no number: "), c)) for c, kind in (("lat_text", "double"), ("lon_text", "double"), ("turn_text", "int")))))
    out = fields.join(actions, "photo_id").join(first, "photo_id").join(own, "photo_id")
    return out.withColumns({"lat": value("lat_text", "double"), "lon": value("lon_text", "double"), "degrees": F.pmod(value("turn_text", "int"), F.lit(360)), "date_taken": F.try_to_timestamp(F.col("date_text")).cast("timestamp_ntz"), "bad": F.when(F.size(bad) > 0, F.array_join(bad, ", "))})


def _duplicates(plan: DataFrame) -> DataFrame:
    """Where each photo that leaves for the folder for duplicates goes."""
    rows = plan.where("move").withColumn("to", F.concat_ws("/", "scan_root", F.lit(DUPLICATES_FOLDER), F.nullif("folder", F.lit(""))))
    there = _probed(rows.select(F.col("to").alias("path")), _below)
    taken = there.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"), F.regexp_extract("path", "([^/]*)$", 1).alias("filename"))
    files = rows.select("photo_id", "path", F.col("to").alias("folder"), "filename", F.col("turn").alias("ord"))
    beside = lambda folder, c: F.concat_ws("/", folder, c)
    return edits.move_plan(files, taken).select("photo_id", "path", beside("folder", "target").alias("target"), F.concat(exprs.stem(F.col("path")), F.lit(".xmp")).alias("sidecar"), beside("folder", "sidecar_target").alias("sidecar_target"))


def _write(row: dict) -> None:
    if row["bad"]:
        raise ValueError(row["bad"])
    if row["writer"] == "exif":
        sinks.put(row["path"], jpeg.tagged(sinks.content(row["path"]), *(row[c] for c in jpeg.PAYLOAD)))
    elif sinks.exists(row["path"]):
        sinks.put(row["path"][: row["path"].rfind(".")] + ".xmp", row["xmp"].encode())
    else:
        raise FileNotFoundError(f"{row['path']} no longer exists")


def _turned(turn: Turn | None, run: str) -> Callable[[dict], None]:
    def act(row: dict) -> None:
        if row["bad"]:
            raise ValueError(row["bad"])
        if not row["degrees"]:
            return
        if row["writer"] != "exif" or turn is None:
            raise ValueError("only JPEG files can be turned, and only with a function that turns them")
        before = _waiting(row["path"], f"{run}-before")  # what is turned is always the file as it was
        if not sinks.exists(before):
            sinks.put(before, sinks.content(row["path"]))
        sinks.put(row["path"], turn(sinks.content(before), row["degrees"]))

    return act


def _renames(spark: SparkSession, journal: Journal, run: str, plan: DataFrame, photos: DataFrame, well: Callable[[DataFrame], DataFrame]) -> list[DataFrame]:
    """Renames of photos that have gone well so far: all away from their old names, then all to their new ones, so that no order of files matters."""
    items = well(plan.where("renames")).select(F.col("turn").alias("ord"), "scan_root", F.col("photo_id").alias("id"), F.trim("new_name").alias("new_name"))
    if items.limit(1).isEmpty():
        return []
    stays = well(photos.withColumn("photo_id", F.col("id"))).drop("photo_id").join(plan.where("move").select(F.col("photo_id").alias("id")), "id", "left_anti")

    def names() -> renames.Renamed:
        path = F.concat("scan_root", F.lit("/"), "id")
        asked = items.where(~F.col("new_name").rlike(r"[/\\]")).select(F.concat(F.regexp_replace(path, "[^/]+$", ""), "new_name").alias("path"))
        beside = items.select(F.concat(exprs.stem(path), F.lit(".xmp")).alias("path"))
        there = journal.once("names_there", lambda: _probed(asked.union(beside), _itself))
        return renames.renamed(photos.join(plan.where("move").select(F.col("photo_id").alias("id")), "id", "left_anti"), items, there, there.where("path like '%.xmp'"))

    if not (journal.has("rename_results") and journal.has("rename_moves")):
        got = names()
        journal.once("rename_results", lambda: got.results)
        journal.once("rename_moves", lambda: got.moves.join(got.log.select("new_path", "ord"), "new_path").join(items.select("ord", F.col("id").alias("photo_id")), "ord"))
    results, moves = (journal.once(n, stays.limit) for n in ("rename_results", "rename_moves"))
    refused = results.where("not ok").select(F.col("id").alias("photo_id"), F.lit("rename").alias("action"), "ok", F.concat(F.lit("ValueError: "), "error").alias("error"))

    def away(row: dict) -> None:
        _with_sidecar(row["old_path"], _waiting(row["new_path"], run), row["sidecar_from"], row["sidecar_to"] and _waiting(row["sidecar_to"], run))

    def home(row: dict) -> None:
        _with_sidecar(_waiting(row["new_path"], run), row["new_path"], row["sidecar_to"] and _waiting(row["sidecar_to"], run), row["sidecar_to"])

    first = journal.once("renames_away", lambda: _marks(moves, away, "rename"))
    ready = moves.join(first.where("ok").select("photo_id"), "photo_id", "left_semi")
    second = journal.once("renames_home", lambda: _marks(ready, home, "rename"))
    return [refused, first.where("not ok"), second]


class Commit:
    """``results`` (photo_id, ok, error) for each photo, ``marks`` (photo_id, action, ok, error) for each action, and the changes and photos afterwards."""

    def __init__(self, results: DataFrame, marks: DataFrame, changes: DataFrame, photos: DataFrame):
        self.results, self.marks, self.changes, self.photos = results, marks, changes, photos


def plan_of(changes: DataFrame, photos: DataFrame, ids: list[int] | None = None) -> DataFrame:
    """What a commit would do: photo_id, move, write, rotate, renames."""
    return _plan(changes, photos, ids).select("photo_id", "move", "write", "rotate", "renames")


def committed(spark: SparkSession, changes: DataFrame, photos: DataFrame, folder: str, run: str, ids: list[int] | None = None, turn: Turn | None = None) -> Commit:
    """Carries out uncommitted ``changes`` (those of ``ids``, if any) on the files of ``photos`` (id, scan_root, folder, filename, original_filename, path).

    ``folder`` is where journals lie (shared by all machines), ``run`` names this one: the same name goes on
    with a run that broke off, also one that has ended, and then changes nothing.
    A photo that moves to the folder for duplicates does nothing else and leaves the library with its changes. For others tags or a
    sidecar come first, then the turn, then the name; where one fails, the rest of that photo is left
    out and its changes stay uncommitted. Photos move before others are renamed, so names that they free
    can be taken. The library keeps place and date as they were, until the files are scanned again.
    """
    journal = Journal(spark, folder, run)
    plan = journal.once("plan", lambda: _plan(changes, photos, ids))
    photos_before = journal.once("photos", lambda: photos)
    changes_before = journal.once("changes", lambda: changes)
    marks = []

    def step(name: str, rows: DataFrame, act: Callable[[dict], None], action: str) -> None:
        marks.append(journal.once(name, lambda: _marks(rows, act, action)))

    def well(rows: DataFrame) -> DataFrame:
        for m in marks:
            rows = rows.join(m.where("not ok").select("photo_id"), "photo_id", "left_anti")
        return rows

    duplicates = journal.once("duplicates", lambda: _duplicates(plan))
    step("moved", duplicates, lambda r: _with_sidecar(r["path"], r["target"], r["sidecar"], r["sidecar_target"]), "move")
    files = sinks.jpeg_payload(plan).withColumn("writer", sinks.writer(F.col("filename")))
    files = library.sidecar(files.withColumn("date_taken", F.col("date_text"))).drop("date_taken")
    step("written", files.where("write"), _write, "write")
    step("turned", well(files.where("rotate")), _turned(turn, run), "rotate")
    marks += _renames(spark, journal, run, plan, photos_before, well)
    step("tidied", files.where("rotate and writer = 'exif'").join(marks[0].select("photo_id"), "photo_id", "left_anti"), lambda r: _gone(_waiting(r["path"], f"{run}-before")), "tidy")

    every = marks[0]
    for m in marks[1:]:
        every = every.unionByName(m)
    failed = every.where("not ok").groupBy("photo_id").agg(F.min("error").alias("error"))
    results = plan.select("photo_id").join(failed, "photo_id", "left").select("photo_id", F.col("error").isNull().alias("ok"), "error")
    gone = marks[0].where("ok").select("photo_id")
    left = changes_before.join(gone, "photo_id", "left_anti").select(changes.columns)
    after = photos_before.join(gone.withColumnRenamed("photo_id", "id"), "id", "left_anti").select(photos.columns)
    if journal.has("renames_home"):
        new = journal.once("renames_home", lambda: every).where("ok").join(journal.once("rename_moves", lambda: every), "photo_id").select(F.col("photo_id").alias("id"), F.col("new_path").alias("_to"))
        after = after.join(new, "id", "left")
        hit = F.col("_to").isNotNull()
        values = {"id": F.expr("substring(_to, length(scan_root) + 2)"), "filename": F.regexp_extract("_to", "([^/]+)$", 1), "path": F.col("_to"), "original_filename": F.coalesce("original_filename", "filename")}
        after = after.select(*(F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else c for c in photos.columns))
    return Commit(results, every.where("action <> 'tidy'"), edits.committed(left, results), after)


def _gone(path: str) -> None:
    store, at = sinks.opened(path)
    if store.get_file_info(at).type == fs.FileType.File:
        store.delete_file(at)
