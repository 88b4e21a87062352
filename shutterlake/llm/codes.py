"""Compressed vectors: each of four parts of a vector becomes the index of an entry of a codebook.

Equal integer parts at one position are one weighted row, so that copies of a
vector cost their codebook's rounds nothing. The rounds (weighted Lloyd) run over
these distinct rows: a task sums its rows by entry before anything is shuffled,
and the driver only ever holds the codebooks, ENTRIES vectors' worth of integers.
Codes and errors are then joined back to the vectors by their parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored, scratch

PARTS, ENTRIES, ROUNDS = 4, 256, 4
SCALE = 1024
LONGEST = 2**63 - 1
#: Rows whose distances to all entries are held at once.
CHUNK = 4096


def nearest(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``rows`` the index of the nearest entry of ``book`` (the lowest of equals) and its squared distance; exact.

    Doubles hold every sum unless it could pass 2^53; Python's integers do then.
    """
    most = max(1, *(int(max(abs(int(m.max(initial=0))), abs(int(m.min(initial=0))))) for m in (rows, book)))
    kind = float if 4 * most * most * max(1, book.shape[1]) < 2**53 else object
    entries = book.astype(kind)
    lengths = (entries * entries).sum(axis=1)
    code, far = np.zeros(len(rows), np.int64), np.zeros(len(rows), kind)
    for at in range(0, len(rows), CHUNK):
        x = rows[at : at + CHUNK].astype(kind)
        # without the row's own length, which is the same for all entries
        d = lengths[None, :] - 2 * (x @ entries.T)
        best = np.argmin(d, axis=1)
        code[at : at + CHUNK] = best
        far[at : at + CHUNK] = d[np.arange(len(x)), best] + (x * x).sum(axis=1)
    return code, far


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column("part").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _by_position(batch: pa.RecordBatch, books: list[np.ndarray], width: int):
    position, rows = batch.column("position").to_numpy(), _matrix(batch, width)
    for p, book in enumerate(books):
        at = np.flatnonzero(position == p)
        if len(at):
            yield p, at, rows[at], *nearest(rows[at], book)


SUMS = pa.schema([("position", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0)))])


def _sums(books: list[np.ndarray], width: int):
    """A task's weighted sums by position and entry: one row each, whatever it has read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = [np.zeros(len(b), object) for b in books]
        total = [np.zeros(b.shape, object) for b in books]
        for batch in batches:
            weight = batch.column("weight").to_numpy()
            for p, at, rows, code, _ in _by_position(batch, books, width):
                w = weight[at]
                safe = int(np.abs(rows).max(initial=0)) < 2**31 and int(w.sum()) < 2**31
                weighted = (rows if safe else rows.astype(object)) * w[:, None]
                order = np.argsort(code, kind="stable")
                used, start = np.unique(code[order], return_index=True)
                total[p][used] += np.add.reduceat(weighted[order], start, axis=0)
                count[p][used] += np.add.reduceat(w[order], start)
        rows = [(p, e, int(count[p][e]), [Decimal(int(v)) for v in total[p][e]]) for p in range(len(books)) for e in np.flatnonzero(count[p])]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), SUMS.types, strict=True)], schema=SUMS)

    return run


CODED = pa.schema([("position", pa.int32()), ("part", pa.list_(pa.int64())), ("entry", pa.int64()), ("far", pa.int64())])


def _codes(books: list[np.ndarray], width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entry, far = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for _, at, _, code, d in _by_position(batch, books, width):
                entry[at] = code
                far[at] = np.minimum(d, LONGEST) if d.dtype == object else d
            yield pa.RecordBatch.from_arrays([batch.column("position"), batch.column("part").cast(pa.list_(pa.int64())), pa.array(entry), pa.array(far)], schema=CODED)

    return run


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id, label and q, floor(1024 * x) of each component (all down); vectors that are null or hold null or non-finite components are left out."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    fine = F.forall("x", lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)) & ~F.isnan(v))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), x.alias("x")).where(F.col("x").isNotNull() & fine)
    return rows.select("vec_id", "label", F.transform("x", lambda v: F.floor(v * SCALE).cast("long")).alias("q"))


def codebooks(parts: DataFrame, first: list[list[int]], width: int, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The four codebooks after ``rounds`` of weighted Lloyd over distinct ``parts`` (position, part, weight), begun from the parts of the vectors in ``first``.

    An entry becomes floor(weighted sum / weight) in each component; one that no part is nearest to stays.
    """
    start = np.array(first, np.int64).reshape(len(first), PARTS, width)
    books = [start[:, p].copy() for p in range(PARTS)]
    for _ in range(rounds if len(first) else 0):
        some = parts.mapInArrow(_sums(books, width), "position int, entry int, n long, sums array<decimal(38,0)>")
        long = some.select("position", "entry", "n", F.posexplode("sums").alias("at", "v"))
        for r in long.groupBy("position", "entry", "at").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
            books[r.position][r.entry, r.at] = int(r.v) // r.n
    return books


def compressed(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of each usable row of ``vectors`` (vec_id, embedding, label).

    Vectors are cut into four equal parts; shorter ones are extended with noughts
    to the longest, and all to a multiple of four. The codebooks begin with
    the 256 smallest vec_ids (of rows with one id the smaller vector comes first; rows
    without one come into no codebook but are coded); fewer vectors give fewer entries,
    none with an id code 0 against entries of noughts. Repeated rows stay rows of their
    own. label_error sums errors over equal labels, nulls together. An error beyond a long
    is given as the largest long. An empty table gives an empty result; other
    columns are ignored. The result's table is left in the shared folder.
    """
    with scratch() as kept:
        out = _compressed(vectors, rounds)
        kept.append(out)
    return out.df


def _compressed(vectors: DataFrame, rounds: int) -> Stored:
    # row numbers are part of the table that is written, so they hold when a task runs again
    base = Stored(integers(vectors).withColumn("row", F.monotonically_increasing_id()), "integers").df
    width = max(1, -(-(base.agg(F.max(F.size("q"))).first()[0] or 0) // PARTS))
    whole = F.concat("q", F.array_repeat(F.lit(0).cast("long"), F.lit(PARTS * width) - F.size("q")))
    base = base.withColumn("q", whole)
    cut = F.array(*(F.struct(F.lit(p).alias("position"), F.slice("q", p * width + 1, width).alias("part")) for p in range(PARTS)))
    pieces = base.select("row", F.inline(cut))
    parts = Stored(pieces.groupBy("position", "part").agg(F.count("*").alias("weight")), "parts").df
    first = [list(r.q) for r in base.where("vec_id is not null").orderBy("vec_id", "q").select("q").limit(ENTRIES).collect()]
    books = codebooks(parts, first or [[0] * (PARTS * width)], width, rounds if first else 0)
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode() if first else b"").hexdigest()

    coded = parts.mapInArrow(_codes(books, width), "position int, part array<bigint>, entry long, far long")
    found = pieces.join(coded, ["position", "part"]).groupBy("row").agg(F.sum(F.expr("shiftleft(entry, 8 * (3 - position))")).alias("code"), F.sum(F.col("far").cast("decimal(38,0)")).alias("error"))
    longest = lambda c: F.least(c, F.lit(Decimal(LONGEST))).cast("long")
    rows = base.select("row", "vec_id", "label").join(found, "row")
    rows = Stored(rows.select("vec_id", "label", F.lower(F.lpad(F.hex("code"), 8, "0")).alias("code"), longest(F.col("error")).alias("error")), "coded").df
    sums = rows.groupBy(F.col("label").alias("of")).agg(longest(F.sum(F.col("error").cast("decimal(38,0)"))).alias("label_error"))
    out = rows.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return Stored(out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")), "compressed")
