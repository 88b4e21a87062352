"""Connected components of a table of edges: local contraction, then large and small stars until every node hangs on its smallest."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Stored

#: Edges that a task contracts at once; its memory is bound by them.
CHUNK = 1_000_000


def _contracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges as stars: (root, node) for each node that a chunk's edges connect to a smaller one."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := above.setdefault(x, x)) != x:
            above[x] = above[up]
            x = up
        return x

    def stars() -> pd.DataFrame:
        rows = [(r, x) for x in list(above) if (r := top(x)) != x]
        above.clear()
        return pd.DataFrame(rows, columns=["root", "id"])

    done = 0
    for batch in batches:
        for a, b in zip(batch["a"].tolist(), batch["b"].tolist(), strict=True):
            a, b = top(a), top(b)
            above[max(a, b)] = min(a, b)
        done += len(batch)
        if done >= CHUNK:
            done = 0
            yield stars()
    yield stars()


def _large(stars: DataFrame) -> DataFrame:
    """Each node's larger neighbours go to the smallest node of its neighbourhood."""
    both = stars.select(F.col("root").alias("u"), F.col("id").alias("v")).unionByName(stars.select(F.col("id").alias("u"), F.col("root").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("root"))
    return both.where("v > u").join(low, "u").where("root <> v").select("root", F.col("v").alias("id")).distinct()


def _small(stars: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours go to the smallest of these."""
    low = stars.groupBy("id").agg(F.min("root").alias("low"))
    joined = stars.join(low, "id")
    return joined.select(F.col("low").alias("root"), F.explode(F.array("id", "root")).alias("id")).where("root <> id").distinct()


def _settled(stars: DataFrame) -> bool:
    """Whether each node has one root and no root has one of its own."""
    ends = stars.select("id", F.lit(True).alias("hangs")).unionByName(stars.select(F.col("root").alias("id"), F.lit(False).alias("hangs")))
    hangs = F.count_if("hangs")
    return ends.groupBy("id").agg(hangs.alias("n"), F.bool_and("hangs").alias("only")).where("n > 1 or (n = 1 and not only)").isEmpty()


def roots(edges: DataFrame) -> Stored:
    """id and root, the smallest node of its component, for each node of ``edges`` (a, b: long) that is not the smallest itself; rounds grow with the logarithm of the longest path."""
    names = "root long, id long"
    now = Stored(edges.select("a", "b").where("a <> b").mapInPandas(_contracted, names).distinct(), "components")
    while not _settled(now.df):
        later = Stored(_small(_large(now.df)), "components")
        now.drop()
        now = later
    return now
