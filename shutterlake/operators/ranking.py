"""Numbering rows in an order without one task for a group: ranks within parts, plus the rows of earlier parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a part, about, and parts at most.
PART_ROWS, PARTS = 200_000, 4096


def numbered(df: DataFrame, keys: list[str], order: str, column: str, part_rows: int = PART_ROWS) -> DataFrame:
    """``df`` with each row's number from 1 among those of its ``keys``, in the order of the numeric column ``order`` (nulls first).

    Parts are stretches of ``order`` between its approximate quantiles, so a key
    that holds most rows is ranked in many tasks.
    """
    parts = min(PARTS, max(1, df.count() // part_rows))
    edges = df.agg(F.percentile_approx(order, [k / parts for k in range(1, parts)], 10_000)).first()[0] if parts > 1 else None
    bounds = F.array(*map(F.lit, sorted(set(edges or [])))) if edges else None
    part = F.size(F.filter(bounds, lambda e: e <= F.col(order))) if edges else F.lit(0)
    out = df.withColumn("_part", F.coalesce(part, F.lit(0)))
    counts = out.groupBy(*keys, "_part").agg(F.count("*").alias("_c"))
    below = Window.partitionBy(*(F.col(f"_k{i}") for i in range(len(keys)))).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_part").alias("_p"), "_c")
    counts = counts.withColumn("_below", F.coalesce(F.sum("_c").over(below), F.lit(0))).drop("_c")
    own = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(F.asc_nulls_first(order)))
    on = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = out.withColumn("_own", own).join(counts, on).withColumn(column, (F.col("_own") + F.col("_below")).cast("int"))
    return out.drop("_part", "_own", "_below", "_p", *(f"_k{i}" for i in range(len(keys))))
