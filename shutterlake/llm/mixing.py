"""Mixing sources to target weights by Pfair scheduling.

Each source's documents are ranked and cut into blocks. Block i (from 1) of a
source with weight w is released at floor((i - 1) / w) and due at ceil(i / w);
at each slot the released block with the earliest deadline goes next. At any
time each source that still has blocks is then less than one block from its
share. Weights are whole numbers of ``cycle`` slots, so the schedule repeats:
one cycle is planned on the driver and its size depends on the number of sources
alone; documents find their slot with a join on that table. All of it are
DataFrame operations. Sources beyond the largest ``LANES`` share a lane that has
the sum of their weights. Its blocks are dealt by a second schedule, of the
different weights among them, and in turn to the sources of the same weight: a
source is then less than one block from its share of the lane's blocks. Ranks are counted within parts of a source, so a source
that holds most rows is not ranked in one task.
"""

from __future__ import annotations

import heapq
import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Stored

BLOCK = 16
#: Sources with a lane of their own; all smaller ones share one more lane.
LANES = 1024
#: A cycle is made longer for the sake of small weights up to so many slots.
CYCLE = 1 << 15
PARTS, PART_ROWS = 256, 200_000


def quotas(weights: list[float], cycle: int) -> list[int]:
    """Whole numbers that sum to ``cycle``, by largest remainders, one at least."""
    total = sum(weights)
    exact = [w / total * cycle for w in weights]
    out = [max(1, int(x)) for x in exact]
    order = sorted(range(len(out)), key=lambda k: (exact[k] - out[k], -k))
    for _ in range(cycle - sum(out)):
        out[order.pop()] += 1
    for _ in range(sum(out) - cycle):  # those raised to one are paid for by the largest
        out[out.index(max(out))] -= 1
    return out


def schedule(quota: list[int]) -> list[int]:
    """The lane of each slot of a cycle: earliest deadline first among released blocks."""
    cycle = sum(quota)
    waiting = [(0, k, 1) for k in range(len(quota))]  # (release, lane, block)
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []  # (deadline, lane, block)
    out = []
    for slot in range(cycle):
        while waiting and waiting[0][0] <= slot:
            _, lane, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-i * cycle // quota[lane]), lane, i))
        due, lane, i = heapq.heappop(ready)
        if slot >= due:
            raise AssertionError("a block missed its deadline")
        out.append(lane)
        if i < quota[lane]:
            heapq.heappush(waiting, (max(slot + 1, i * cycle // quota[lane]), lane, i + 1))
    return out


def _rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    return spark.range(1, numPartitions=1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def _cycle(weights: list[float]) -> tuple[int, list[int], list[tuple[int, int, int]]]:
    """A cycle's length, quotas and (lane, which of its slots, slot). The smallest weight gets eight slots, where ``CYCLE`` has room for that."""
    least = max(1000, 8 * len(weights))
    cycle = max(least, int(min(CYCLE, 8 * sum(weights) / min(weights))))
    quota = quotas(weights, cycle)
    place, slots = [0] * len(quota), []
    for slot, lane in enumerate(schedule(quota)):
        slots.append((lane, place[lane], slot))
        place[lane] += 1
    return cycle, quota, slots


def _members(sized: DataFrame, of_lane: DataFrame, weights: dict | None, least: float) -> DataFrame:
    """The sources without a lane: _s, what their weight follows from (_key: the weight given, or the number of rows), and their number from 0 among those of the same key (_turn)."""
    out = sized.select(F.col("source").cast("string").alias("_s"), F.col("count").cast("double").alias("_key"))
    out = out.join(F.broadcast(of_lane), F.col("_s").eqNullSafe(F.col("_source")), "left_anti")
    if weights:  # as many as the caller gives
        given = _rows(out.sparkSession, [{"_g": s, "_w": float(w)} for s, w in weights.items() if w > 0], "_g:string,_w:double")
        out = out.join(F.broadcast(given), F.col("_s").eqNullSafe(F.col("_g")), "left").select("_s", F.coalesce("_w", F.lit(float(least))).alias("_key"))
    out = out.withColumn("_part", F.pmod(F.xxhash64("_s"), F.lit(PARTS)).cast("int"))
    below = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = out.groupBy("_key", "_part").count().select("_key", "_part", F.coalesce(F.sum("count").over(below), F.lit(0)).alias("_below"))
    out = out.withColumn("_n", F.row_number().over(Window.partitionBy("_key", "_part").orderBy("_s"))).join(counts, ["_key", "_part"])
    return out.select("_s", "_key", (F.col("_n") - 1 + F.col("_below")).alias("_turn"))


def mixed(docs: DataFrame, weights: dict[str | None, float] | None = None, block: int = BLOCK, temper: float = 0.5, column: str = "mix_position") -> DataFrame:
    """``docs`` (doc_id, source, ...) with each row's place in the mix in ``column``.

    ``weights`` names each source's target weight (sources without one, or with
    none above zero, get the smallest given one); by default a source weighs
    its number of rows to the power ``temper``. A null source is a source. Every
    row is kept and places are distinct; a source that has run out leaves gaps.
    Rows that repeat are separate rows. The block, release and deadline beside
    the place are those of the source's lane. Within a source the order is that of
    hashed parts, then doc_id. An empty table stays empty. A column that is
    already named ``column`` is replaced.
    """
    spark = docs.sparkSession
    names = [c for c in docs.columns if c != column]
    sized = docs.groupBy("source").count()
    lanes = sized.orderBy(F.desc("count"), F.asc_nulls_first("source")).limit(LANES + 1).collect()
    if not lanes:
        return docs.select(*names, F.lit(0).cast("long").alias(column))
    shared = len(lanes) > LANES
    lanes = lanes[:LANES]
    if weights:
        least = min(w for w in weights.values() if w > 0)
        weigh = [max(weights.get(r["source"], 0), 0) or least for r in lanes]
    else:
        weigh = [float(r["count"]) ** temper for r in lanes]
    rows = docs.count()
    members = None
    if shared:
        taken = _rows(spark, [{"_source": r["source"]} for r in lanes], "_source:string")
        members = Stored(_members(sized, taken, weights, least if weights else 0), "members").df
        # the different weights: at most the root of twice the rows, or as many as are given
        kinds = sorted(tuple(r) for r in members.groupBy("_key").count().collect())
        heavy = [(key if weights else key**temper) * n for key, n in kinds]
        weigh.append(sum(heavy))
    cycle, quota, slots = _cycle(weigh)
    of_lane = _rows(spark, [{"_source": r["source"], "_lane": k, "_quota": quota[k]} for k, r in enumerate(lanes)], "_source:string,_lane:int,_quota:int")
    as_rows = lambda slots: _rows(spark, [{"_lane": a, "_k": k, "_slot": t} for a, k, t in slots], "_lane:int,_k:long,_slot:long")
    of_slot = as_rows(slots)

    parts = max(PARTS, rows // PART_ROWS)
    # both tables have a bounded number of rows: LANES, and eight for each lane or CYCLE
    out = docs.select(*names, F.col("source").cast("string").alias("_s")).join(F.broadcast(of_lane), F.col("_s").eqNullSafe(F.col("_source")), "left")
    out = out.withColumns({"_lane": F.coalesce("_lane", F.lit(len(quota) - 1)), "_quota": F.coalesce("_quota", F.lit(quota[-1])), "_part": F.pmod(F.xxhash64("doc_id", "_s"), F.lit(parts)).cast("int")})
    # sources that share a lane are ranked each for itself
    out = out.withColumn("_own", F.when((F.col("_lane") < len(lanes)) | F.col("_s").isNull(), "").otherwise(F.concat(F.lit("="), "_s")))
    keys = ["_lane", "_own", "_part"]
    counts = out.groupBy(*keys).count()
    below = Window.partitionBy("_lane", "_own").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*keys, F.coalesce(F.sum("count").over(below), F.lit(0)).alias("_below"))
    out = out.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("doc_id"))).join(counts, keys)
    out = out.withColumn("_rank", F.col("_n") - 1 + F.col("_below")).withColumn("_i", F.expr(f"_rank div {block}"))
    if shared:
        inner, share, turns = _cycle(heavy)
        of_key = _rows(spark, [{"_key": key, "_kind": k, "_many": n, "_share": share[k]} for k, (key, n) in enumerate(kinds)], "_key:double,_kind:int,_many:long,_share:long")
        of_turn = as_rows(turns).toDF("_kind", "_t", "_at")
        low = out.where(F.col("_lane") == len(lanes)).withColumnRenamed("_s", "_of")
        low = low.join(members, F.col("_of").eqNullSafe(F.col("_s"))).join(F.broadcast(of_key), "_key").withColumn("_b", F.expr("_i * _many + _turn"))
        low = low.withColumn("_t", F.expr("_b % _share")).join(F.broadcast(of_turn), ["_kind", "_t"]).withColumn("_i", F.expr(f"(_b div _share) * {inner} + _at"))
        out = low.select(out.columns).unionByName(out.where(F.col("_lane") < len(lanes)))
    out = out.withColumn("_k", F.expr("_i % _quota")).join(F.broadcast(of_slot), ["_lane", "_k"])
    at = F.expr(f"((_i div _quota) * {cycle} + _slot) * {block} + _rank % {block}")
    return out.select(*names, at.alias(column), *(F.expr(e).alias(f"{column}_{k}") for k, e in (("block", "_i"), ("release", f"(_i * {cycle}) div _quota"), ("deadline", f"((_i + 1) * {cycle} + _quota - 1) div _quota"))))


def in_order(docs: DataFrame, weights: dict[str | None, float] | None = None, block: int = BLOCK) -> DataFrame:
    """``docs``, same columns, range-partitioned and sorted by the place in the mix: written files follow it."""
    place = "_mix_position"
    return mixed(docs, weights, block, column=place).repartitionByRange(place).sortWithinPartitions(place).select(docs.columns)


def places(docs: DataFrame, column: str) -> DataFrame:
    """``docs`` with each row's place in ``column``, in the order of the files it is read from, as ``in_order`` has had them written: number of the writing task, of its file, of the row. What isn't read from files is mixed anew."""
    name = F.col("_metadata.file_name")
    number = lambda pattern: F.coalesce(F.regexp_extract(name, pattern, 1).try_cast("long"), F.lit(0))
    task, file = number("^part-([0-9]+)-"), number("-c([0-9]+)[.]")
    try:
        return docs.select("*", (F.shiftleft(task, 44) + F.shiftleft(file, 32) + F.col("_metadata.row_index")).alias(column))
    except AnalysisException:
        return mixed(docs, column=column).select(*docs.columns, column)
