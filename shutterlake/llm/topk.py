"""Exact top-k inner products by Fagin's threshold algorithm.

Vectors are dealt to blocks by a hash of their id; each block of candidates
meets each block of queries once, in a task of bounded size. Inside, every
dimension has a list of the candidates sorted by its component. A query walks
its lists together, from the top or the bottom by the sign of its own component,
scores what it meets, and stops when the sum over the lists of what they can
still give falls below its k-th score, or when it has met all of the block. Lists
are read in stretches that double. The blocks' answers are merged by a
ranking that keeps k rows of each query before the shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CANDIDATES, QUERIES = 8192, 2048
DEPTH = 8


class Lists:
    """A block of candidates with a sorted list for each dimension. Candidates are in the order of their ids."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order]
        self.order = np.ascontiguousarray(np.argsort(self.x, axis=0, kind="stable").T)
        self.sorted = np.take_along_axis(self.x.T, self.order, axis=1)

    def top(self, queries: np.ndarray, q: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
        """For each query (score, id) of the k best other candidates, ties to smaller ids. ``read`` has the depth that its lists were read to, ``met`` how many candidates it scored."""
        self.read, self.met = np.zeros(len(queries), np.int64), np.zeros(len(queries), np.int64)
        return [self._walk(r, query, v, k) for r, (query, v) in enumerate(zip(queries, q, strict=True))]

    def _best(self, place: np.ndarray, scores: np.ndarray, k: int) -> list[tuple[int, int]]:
        """Of the candidates at ``place``, in ascending order; scores are of all candidates."""
        own = scores[place]
        if len(place) > k and own.dtype != object:
            least = np.partition(own, len(own) - k)[len(own) - k]
            keep = own >= least
            place, own = place[keep], own[keep]
        order = sorted(range(len(place)), key=lambda i: (-own[i], place[i]))[:k]
        return [(int(own[i]), int(self.ids[place[i]])) for i in order]

    def _walk(self, r: int, query: int, q: np.ndarray, k: int) -> list[tuple[int, int]]:
        n, used = len(self.ids), np.flatnonzero(q)
        if not len(used):  # all scores are nought: nothing to sort by, the smallest ids win
            return self._best(np.flatnonzero(self.ids != query), np.zeros(n, np.int64), k)
        up, down = used[q[used] > 0], used[q[used] < 0]
        seen, scored, scores = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, self.x.dtype)
        ahead = np.zeros(0, self.x.dtype)  # the k best scores so far
        depth, step = 0, DEPTH
        while depth < n:
            to = min(n, depth + step)
            seen[self.order[up, n - to : n - depth].ravel()] = True
            seen[self.order[down, depth:to].ravel()] = True
            fresh = np.flatnonzero(seen & ~scored)
            scores[fresh] = self.x[fresh] @ q
            scored[fresh] = True
            depth, step = to, 2 * step
            self.met[r] += len(fresh)
            ahead = np.sort(np.concatenate([ahead, scores[fresh[self.ids[fresh] != query]]]))[-k:]
            bound = (self.sorted[up, n - depth] * q[up]).sum() + (self.sorted[down, depth - 1] * q[down]).sum()
            if self.met[r] == n or (len(ahead) == k and bound < ahead[0]):
                break
        self.read[r] = depth
        return self._best(np.flatnonzero(scored & (self.ids != query)), scores, k)


def matrix(rows: pd.Series, width: int) -> np.ndarray:
    """Vectors as rows, shorter ones extended with noughts. Doubles hold the products exactly unless they could pass 2^53; Python's integers do then."""
    out = np.zeros((len(rows), width), np.int64)
    for r, v in enumerate(rows):
        out[r, : len(v)] = v
    return out


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id and q, floor(64 * x) of each component; vectors that are null or have null or non-finite components are left out, of those with one id the smallest stays."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    fine = F.forall("x", lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)) & ~F.isnan(v))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & fine)
    return kept.select("vec_id", F.transform("x", lambda v: F.floor(v * 64).cast("long")).alias("q")).groupBy("vec_id").agg(F.min("q").alias("q"))


def top_k(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """For each vec_id divisible by ``every``: query_id, rank (from 1), vec_id, score of its k highest inner products with other rows.

    Ties go to the smaller vec_id. Rows that repeat a vec_id count as one vector
    (the smallest), vectors of unlike length are extended with noughts, rows
    without an id or with an unusable vector take no part. An empty table gives
    an empty result; other columns are ignored.
    """
    rows = quantised(vectors)
    n = rows.count()
    many = rows.where(F.col("vec_id") % every == 0).count()
    blocks, sets = max(1, -(-n // CANDIDATES)), max(1, -(-many // QUERIES))
    deal = lambda salt, of: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(of)).cast("int")
    all_of = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    candidates = rows.select("vec_id", "q", deal(1, blocks).alias("block"), all_of(sets).alias("set"))
    queries = rows.where(F.col("vec_id") % every == 0).select("vec_id", "q", all_of(blocks).alias("block"), deal(2, sets).alias("set"))

    def search(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        if len(own) and len(asked):
            width = max(map(len, [*own["q"], *asked["q"]]))
            x, q = matrix(own["q"], width), matrix(asked["q"], width)
            top = lambda m: int(max(abs(int(m.max(initial=0))), abs(int(m.min(initial=0)))))
            kind = float if top(x) * top(q) * max(1, width) < 2**53 else object
            lists = Lists(own["vec_id"].to_numpy(), x.astype(kind))
            ids = asked["vec_id"].to_numpy()
            for query, best in zip(ids, lists.top(ids, q.astype(kind), k), strict=True):
                out += [(query, other, score) for score, other in best]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    found = candidates.groupBy("block", "set").cogroup(queries.groupBy("block", "set")).applyInPandas(search, "query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
