"""Renames in the order that they are asked for: a name that an earlier item frees can be taken by a later one.

An item moves a photo from a path to another one. It works if the photo is there and the new
name is free at its turn, so it hangs on earlier items that touch either path. Each round
decides all items whose paths' states follow from decided ones: along each path's touches in
order, a running window knows the last one that worked and how many are open since. An item that hangs on one
open item alone works exactly if that one does; such chains are followed by pointer
doubling, so a folder of n numbered files that all move up by one takes about log n steps.
Names that go round in a circle stay, as none of them is ever free. The earliest open item is always
decided, so the rounds end; only tangles in which items hang on several others need more than a few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shutterlake.functions import exprs

from .scratch import Stored, scratch

NOT_FOUND, INVALID, TAKEN = "not found", "invalid name", "name taken"


def _met(rows: DataFrame, other: DataFrame, on: str | Column, how: str = "inner") -> DataFrame:
    """A join that is never broadcast: paths and numbers are many times as large as the files of stored tables, by which Spark would decide."""
    return rows.join(other.hint("merge"), on, how)


def _full(root: Column, key: Column) -> Column:
    return F.concat(root, F.lit("/"), key)


def _asked(items: DataFrame) -> DataFrame:
    """k, s (path), t (path after), kind: move, skip or invalid."""
    name, own = F.trim(F.coalesce("new_name", F.lit(""))), F.regexp_extract("id", "([^/]+)$", 1)
    path = _full(F.col("scan_root"), F.col("id"))
    kind = F.when((name == "") | (name == own), "skip").when(name.rlike(r"[/\\]"), "invalid").otherwise("move")
    return items.select(F.col("ord").cast("long").alias("k"), path.alias("s"), F.concat(F.regexp_replace(path, "[^/]+$", ""), name).alias("t"), kind.alias("kind"))


def _states(touches: DataFrame) -> DataFrame:
    """``touches`` (p, k, source, ok, held) with what is known of the path before each: state (held or not, null: open) and follow, the one open item that it hangs on."""
    before = Window.partitionBy("p").orderBy("k", "source").rowsBetween(Window.unboundedPreceding, -1)
    open_ = F.col("ok").isNull() & F.col("source").isNotNull()
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)).over(before), F.lit(0))
    rows = touches.withColumns({"_s": count(open_ & F.col("source")), "_t": count(open_ & ~F.col("source"))})
    rows = rows.withColumns({"_e": F.max(F.when(F.col("ok"), F.struct("k", "source", "_s", "_t"))).over(before), "_o": F.max(F.when(open_, F.col("k"))).over(before)})
    base = F.when(F.col("_e").isNull(), F.col("held")).otherwise(~F.col("_e.source"))
    since = {c: F.col(f"_{c}") - F.coalesce(F.col(f"_e._{c}"), F.lit(0)) for c in "st"}
    # open sources can only free a path that is held, open targets only take one that is free
    state = F.when(base & (since["s"] == 0), True).when(~base & (since["t"] == 0), False)
    hangs = F.when(since["s"] + since["t"] == 1, F.col("_o"))
    return rows.withColumns({"state": state, "base": base, "follow": F.when(state.isNull(), hangs)}).drop("_s", "_t", "_e", "_o")


def _followed(nodes: DataFrame) -> DataFrame:
    """``nodes`` (k, ok, follow) after each open one has taken the outcome at the end of what it follows, if that is known."""
    now = Stored(nodes, "follow")
    while True:
        at = now.df.select(F.col("k").alias("follow"), F.col("ok").alias("_ok"), F.col("follow").alias("_next"))
        moving = F.col("ok").isNull() & (F.col("_ok").isNotNull() | F.col("_next").isNotNull())
        both = _met(now.df, at, "follow", "left")
        step = Stored(both.select("k", F.coalesce("ok", "_ok").alias("ok"), F.when(F.coalesce("ok", "_ok").isNull(), F.coalesce("_next", "follow")).alias("follow"), moving.alias("moved")), "follow")
        now.drop()
        now = step
        if now.df.where("moved").limit(1).isEmpty():
            return now.df.select("k", "ok")


def _decided(moves: DataFrame, held: DataFrame) -> DataFrame:
    """k, s, t, ok for ``moves`` (k, s, t, able): ``held`` (p) are the paths that are held at first."""
    now = Stored(moves.select("k", "s", "t", F.when(~F.col("able"), False).alias("ok")), "moves")
    while not now.df.where("ok is null").limit(1).isEmpty():
        both = F.array(F.struct(F.col("s").alias("p"), F.lit(True).alias("source")), F.struct(F.col("t").alias("p"), F.lit(False).alias("source")))
        touches = _met(now.df.where("ok is null or ok").select("k", "ok", F.inline(both)), held.withColumn("held", F.lit(True)), "p", "left").withColumn("held", F.coalesce("held", F.lit(False)))
        known = _states(touches).where("ok is null")
        of = lambda c, source: F.max(F.when(F.col("source") == source, F.col(c)))
        one = known.groupBy("k").agg(*(of(c, source).alias(f"{name}_{c}") for c in ("state", "base", "follow") for name, source in (("s", True), ("t", False))))
        ok = F.when(F.col("s_state") & ~F.col("t_state"), True).when((~F.col("s_state")) | F.col("t_state"), False)
        # a held name is free, and a free one held, exactly if the item that it hangs on works
        follow = F.when(F.col("s_state") & F.col("t_base"), F.col("t_follow")).when(~F.col("t_state") & ~F.col("s_base"), F.col("s_follow"))
        got = _followed(one.select("k", ok.alias("ok"), F.when(ok.isNull(), follow).alias("follow")))
        after = Stored(_met(now.df, got.withColumnRenamed("ok", "_ok"), "k", "left").select("k", "s", "t", F.coalesce("ok", "_ok").alias("ok")), "moves")
        now.drop()
        now = after
    return now.df


def _origins(done: DataFrame) -> DataFrame:
    """``done`` (k, s, t: what has worked) with first, the item that moved the same photo first, and last: whether no later one moves it."""
    both = F.array(F.struct(F.col("s").alias("p"), F.lit(True).alias("source")), F.struct(F.col("t").alias("p"), F.lit(False).alias("source")))
    before = Window.partitionBy("p").orderBy("k").rowsBetween(-1, -1)
    touched = done.select("k", F.inline(both)).withColumn("prev", F.max("k").over(before)).where("source").select("k", "prev")
    now = Stored(touched, "origins")
    later = Stored(now.df.where("prev is not null").select(F.col("prev").alias("k")), "later").df
    while True:
        up = now.df.select(F.col("k").alias("prev"), F.col("prev").alias("_up"))
        step = Stored(_met(now.df, up, "prev", "left").select("k", F.coalesce("_up", "prev").alias("prev"), F.col("_up").isNotNull().alias("moved")), "origins")
        now.drop()
        now = step
        if now.df.where("moved").limit(1).isEmpty():
            break
    ends = _met(done, now.df.select("k", F.coalesce("prev", "k").alias("first")), "k")
    return _met(ends, later.withColumn("_later", F.lit(True)), "k", "left").withColumn("last", F.col("_later").isNull()).drop("_later")


class Renamed:
    """What renames give: ``photos`` after them, ``results`` (an item's ord, id, ok, skipped, error, new_id), the ``log`` of those that worked and the ``moves`` that files need."""

    def __init__(self, photos: DataFrame, results: DataFrame, log: DataFrame, moves: DataFrame):
        self.photos, self.results, self.log, self.moves = photos, results, log, moves


def renamed(photos: DataFrame, items: DataFrame, taken: DataFrame | None = None, sidecars: DataFrame | None = None) -> Renamed:
    """Renames ``items`` (ord, scan_root, id, new_name; ord all different) one after the other, as far as each works at its turn.

    ``photos`` has scan_root, id (path below it), filename and original_filename, and path or not;
    ``taken`` (path) are other files that hold names. An item whose photo isn't there (any more) is an error, a name
    that is blank, null or the photo's own is skipped, one with a separator or that is taken is an error. A
    photo that is renamed can be renamed again under its new id; it keeps the first name that it had.

    moves has a row for each photo that lies elsewhere in the end (old_path, new_path). A sidecar among
    ``sidecars`` (path) goes with the first photo of its stem that leaves, to that one's last name
    (sidecar_from, sidecar_to); of two that would get one name the earlier item's goes. A path
    is sorted in one task by the items that touch it.
    """
    with scratch() as kept:
        asked = Stored(_asked(items), "asked").df
        files = photos.select(_full(F.col("scan_root"), F.col("id")).alias("p"))
        touched = asked.select(F.col("s").alias("p")).union(asked.where("kind = 'move'").select("t")).distinct()
        own = Stored(_met(touched, files, "p", "left_semi"), "own").df
        others = _met(_met(touched, taken.select(F.col("path").alias("p")), "p", "left_semi"), own, "p", "left_anti") if taken is not None else own.limit(0)
        others = Stored(others, "others").df
        # what isn't a photo never moves
        fixed = others.select(F.col("p").alias("s"), F.lit(False).alias("able"))
        moves = _met(asked.where("kind = 'move'"), fixed, "s", "left").select("k", "s", "t", F.coalesce("able", F.lit(True)).alias("able"))
        held = own.union(others)
        moves = _decided(moves, held)
        done = Stored(moves.where("ok").select("k", "s", "t"), "done")
        origins = Stored(_origins(done.df), "ends")

        # what held each item's path at its turn
        touches = done.df.select(F.col("s").alias("p"), "k", F.lit(True).alias("source"), F.lit(True).alias("ok")).union(done.df.select("t", "k", F.lit(False), F.lit(True)))
        readers = _met(asked, done.df.select("k"), "k", "left_anti").select(F.col("s").alias("p"), "k", F.lit(None).cast("boolean").alias("source"), F.lit(None).cast("boolean").alias("ok"))
        state = _states(_met(touches.union(readers), own.withColumn("held", F.lit(True)), "p", "left").withColumn("held", F.coalesce("held", F.lit(False)))).where("source is null").select("k", "state")
        found = _met(_met(asked, state, "k", "left"), done.df.select("k", F.lit(True).alias("did")), "k", "left")
        did, there = F.coalesce("did", F.lit(False)), F.coalesce("state", F.lit(False))
        error = F.when(did, None).when(~there, NOT_FOUND).when(F.col("kind") == "invalid", INVALID).when(F.col("kind") == "move", TAKEN)
        found = found.select(F.col("k").alias("ord"), "s", "t", error.alias("error"), (~did & there & (F.col("kind") == "skip")).alias("skipped"), did.alias("did"))
        results = Stored(_met(items.select(F.col("ord").cast("long").alias("ord"), "scan_root", "id"), found, "ord").select("ord", "scan_root", "id", F.col("error").isNull().alias("ok"), "skipped", "error", F.when(F.col("did"), F.expr("substring(t, length(scan_root) + 2)")).alias("new_id")), "results")

        firsts = origins.df.where("k = first").select("first", F.col("s").alias("old_path"))
        all_ends = _met(origins.df.where("last").select("first", F.col("t").alias("new_path")), firsts, "first")
        every = Stored(all_ends.select("old_path", F.col("new_path").alias("_to")), "every")
        ends = all_ends.where("old_path <> new_path")
        if sidecars is not None:
            beside = lambda c: F.concat(exprs.stem(F.col(c)), F.lit(".xmp"))
            leaves = _met(ends, sidecars.select(F.col("path").alias("sidecar_from")), beside("old_path") == F.col("sidecar_from"), "left").withColumn("_to", beside("new_path"))
            rank = lambda c: F.row_number().over(Window.partitionBy(c).orderBy("first")) == 1
            leaves = leaves.withColumn("sidecar_from", F.when(rank("sidecar_from"), F.col("sidecar_from"))).withColumn("_to", F.when(F.col("sidecar_from").isNotNull(), F.col("_to")))
            leaves = leaves.withColumn("sidecar_to", F.when(F.col("_to").isNotNull() & rank("_to") & (F.col("_to") != F.col("sidecar_from")), F.col("_to")))
            ends = leaves.withColumn("sidecar_from", F.when(F.col("sidecar_to").isNotNull(), F.col("sidecar_from"))).drop("_to")
        else:
            ends = ends.withColumns({"sidecar_from": F.lit(None).cast("string"), "sidecar_to": F.lit(None).cast("string")})
        ends = Stored(ends.drop("first"), "ends")
        moved = _met(photos, every.df, _full(F.col("scan_root"), F.col("id")) == F.col("old_path"), "left")
        hit, key = F.col("_to").isNotNull(), F.expr("substring(_to, length(scan_root) + 2)")
        values = {"id": F.when(hit, key).otherwise(F.col("id")), "filename": F.when(hit, F.regexp_extract("_to", "([^/]+)$", 1)).otherwise(F.col("filename"))}
        values |= {"original_filename": F.when(hit, F.coalesce("original_filename", "filename")).otherwise(F.col("original_filename"))}
        values |= {"path": F.when(hit, F.col("_to")).otherwise(F.col("path"))} if "path" in photos.columns else {}
        log = results.df.where("new_id is not null").select("ord", F.col("new_id").alias("photo_id"), _full(F.col("scan_root"), F.col("id")).alias("old_path"), _full(F.col("scan_root"), F.col("new_id")).alias("new_path"))
        out = Renamed(moved.select(*(values[c].alias(c) if c in values else c for c in photos.columns)), results.df, log, ends.df)
        kept += [results, ends, every]
    return out
