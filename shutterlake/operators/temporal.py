"""Nearest-in-time joins, in both directions, within a tolerance; ties go to the earlier side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MINUTE = 60_000_000
#: Stretches of time that a tolerance is cut into.
STRETCHES = 16
#: Stretches whose ends are carried on in one task.
BLOCK = 4096


def micros(c: Column) -> Column:
    """Microseconds of a wall-clock time, read as UTC."""
    return F.unix_micros(c.cast("timestamp"))


def _nearest(rows: DataFrame, groups: list[str], tolerance_us: int) -> DataFrame:
    """``rows`` with _us and _src (a struct that begins with us and ord, null where a row is no source): _p, the nearest source, where it is within the tolerance.

    A group's time is cut into stretches, so a group that holds most rows is
    dealt to many tasks: each stretch is searched for itself, by running
    aggregates over one sort in each direction, and takes its neighbours' last and
    first source, as far as the tolerance reaches, from a table that has one row for
    each stretch. Of sources with
    one time the earlier side takes the last in ``ord``, the later side the first.
    """
    width = max(1, tolerance_us // STRETCHES)
    keys = [*groups, "_k"]
    rows = rows.withColumn("_k", F.floor(F.col("_us") / width))
    # a row for each stretch, null where it has no source of its own
    ends = rows.groupBy(*keys).agg(F.min("_src").alias("_first"), F.max("_src").alias("_last"))
    # what is carried comes from blocks of stretches; those near a block's edge, as far as a tolerance reaches, stand in the next one too
    block = lambda k: F.floor(k / BLOCK)
    ends = ends.withColumn("_block", F.explode(F.array_distinct(F.array(*(block(F.col("_k") + d) for d in (-STRETCHES - 2, 0, STRETCHES + 2))))))
    ahead = Window.partitionBy(*groups, "_block").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy(*groups, "_block").orderBy(F.desc("_k")).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumns({"_before": F.max("_last").over(ahead), "_after": F.min("_first").over(behind)})
    ends = ends.where(F.col("_block") == block(F.col("_k"))).select(*keys, "_before", "_after")
    up = Window.partitionBy(*keys).orderBy("_us").rangeBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*keys).orderBy(F.desc("_us")).rangeBetween(Window.unboundedPreceding, 0)
    both = rows.join(ends, keys).withColumns({"_b": F.coalesce(F.max("_src").over(up), F.col("_before")), "_f": F.coalesce(F.min("_src").over(down), F.col("_after"))})
    db, df = F.col("_us") - F.col("_b.us"), F.col("_f.us") - F.col("_us")
    pick = F.when(F.col("_b").isNotNull() & (F.col("_f").isNull() | (db <= df)), F.col("_b")).otherwise(F.col("_f"))
    return both.withColumn("_p", pick).where(F.abs(F.col("_p.us") - F.col("_us")) <= tolerance_us)


def nearest_in_group(rows: DataFrame, group: str, time: str, order: str, source: str, target: str, tolerance_us: int, carry: list[str]) -> DataFrame:
    """Targets of ``rows`` with the nearest source of their group: near_<carry>, near_us. Rows without a group or time take no part."""
    with_us = rows.withColumn("_us", micros(F.col(time))).where(F.col(group).isNotNull() & F.col("_us").isNotNull() & (F.col(source) | F.col(target)))
    found = _nearest(with_us.withColumn("_src", F.when(F.col(source), F.struct(F.col("_us").alias("us"), F.col(order).alias("ord"), *carry))), [group], tolerance_us)
    return found.where(target).select(*rows.columns, *(F.col(f"_p.{c}").alias(f"near_{c}") for c in carry), F.abs(F.col("_p.us") - F.col("_us")).alias("near_us"))


def nearest_overall(probes: DataFrame, points: DataFrame, tolerance_us: int, carry: list[str]) -> DataFrame:
    """``probes`` (us, ...) with the nearest of ``points`` (us, ord, ...) on one global timeline: near_<carry>, near_us."""
    names = probes.columns
    asked = probes.where("us is not null").select(F.col("us").alias("_us"), F.struct(*names).alias("_row"))
    given = points.where("us is not null").select(F.col("us").alias("_us"), F.struct("us", "ord", *carry).alias("_src"))
    found = _nearest(asked.unionByName(given, allowMissingColumns=True), [], tolerance_us).where("_row is not null")
    return found.select(*(F.col(f"_row.{c}").alias(c) for c in names), *(F.col(f"_p.{c}").alias(f"near_{c}") for c in carry), F.abs(F.col("_p.us") - F.col("_us")).alias("near_us"))


def uncommitted(changes: DataFrame) -> DataFrame:
    """``changes`` that aren't committed; without that column all are pending, and a null counts as pending."""
    return changes.where(~F.coalesce("committed", F.lit(False))) if "committed" in changes.columns else changes


def effective_positions(photos: DataFrame, pending: DataFrame, key: str = "id") -> DataFrame:
    """``photos`` with pending coordinates laid over: both must be there, be numbers and not be committed. Later rows win."""
    last = lambda f: F.max_by(F.when(F.col("field") == f, F.col("new_value")), F.when(F.col("field") == f, F.col("id"))).try_cast("double")
    over = uncommitted(pending).where(F.col("field").isin("lat", "lon")).groupBy(F.col("photo_id").alias("_key")).agg(last("lat").alias("_lat"), last("lon").alias("_lon")).where("_lat is not null and _lon is not null")
    out = photos.join(over, F.col(key) == F.col("_key"), "left")
    return out.select(*(c for c in photos.columns if c not in ("lat", "lon", "has_gps")), F.coalesce("_lat", "lat").alias("lat"), F.coalesce("_lon", "lon").alias("lon"), (F.col("_key").isNotNull() | F.col("has_gps")).alias("has_gps"))
