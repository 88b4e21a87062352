"""What the operators of this package share: reading tables, cutting lineage, splitting words.

Executors may vanish, so lineage is cut with Parquet tables under
``spark.checkpoint.dir`` (a folder that driver and executors share) and never
with node-local checkpoints.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shutterlake.operators.scratch import Stored, scratch, stored  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What Python workers get at once: so many rows and bytes at most, so that neither many rows nor long texts need much memory.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}


def bound_batches(spark: SparkSession) -> None:
    """``BATCH`` holds from now on, where the session doesn't set these itself: for results that are executed later."""
    for key, value in BATCH.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


@contextmanager
def small_batches(spark: SparkSession):
    """``BATCH`` holds for what is executed inside."""
    before = {key: spark.conf.get(key, None) for key in BATCH}
    for key, value in BATCH.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished stages, which go when their handles are collected."""
    gc.collect()
    spark._jvm.System.gc()


def give_back() -> None:
    """At a task's end: what its caches took goes back to the system. Spark keeps Python workers for later tasks, more of them than run at once, and each would hold its share."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
        trim(0)


def by_batch(build: Callable[[], Callable[[pa.RecordBatch], dict]], types: dict[str, pa.DataType]):
    """For mapInArrow: ``build`` makes a worker's function from batches to columns (Arrow arrays or lists).

    Arrow keeps ids whole: pandas would read a batch with a null among its ids as doubles.
    """
    schema = pa.schema(list(types.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = build()
        try:
            for batch in batches:
                columns = work(batch)
                arrays = [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, t) for c, t in ((columns[n], t) for n, t in types.items())]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)
        finally:
            work = batch = columns = arrays = None
            give_back()

    return run


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64 (splitmix64's), so that hash order looks random."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """word (bytes) -> 64-bit hash; emptied at ``limit`` entries, so memory stays bounded."""

    def __init__(self, limit: int = 100_000):
        import xxhash

        super().__init__()
        self.of, self.limit = xxhash.xxh3_64_intdigest, limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = h = self.of(word)
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of ``n`` word hashes; fewer words give one hash of all, none gives none."""
    if not len(words):
        return words
    width = min(n, len(words))
    out = np.full(len(words) - width + 1, 0x9E3779B97F4A7C15 * width % 2**64, np.uint64)
    for k in range(width):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += words[k : k + len(out)]
    return mix64(out)


def numbers(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """``df`` with each row's number from 0 in the order ``by`` (no two rows alike): sorted by ranges, numbered within them, plus the rows of earlier ranges."""
    ranged = Stored(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id()), "ranged").df
    counts = ranged.groupBy("_part").count()
    below = counts.select("_part", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_below"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*by)) - 1
    return ranged.withColumn("_own", own).join(F.broadcast(below), "_part").withColumn(column, F.col("_own") + F.col("_below")).drop("_part", "_own", "_below")


def crc_fold(column: str, parts: int) -> F.Column:
    """crc32 of an id as text, modulo ``parts``."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(parts))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: F.Column, rows: int) -> DataFrame:
    """About ``rows`` labelled training rows (doc_id, text, y), at most twice as many, chosen by a hash of doc_id.

    Only this bounded list of ids is broadcast. Labels that are null, or that
    contradict each other for one doc_id, are left out. Of rows that repeat a
    doc_id the smallest text stands for all, so there is one row for each id.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & train).groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("z")).where("y = z")
    share = int(min(1.0, rows / max(1, labels.count())) * 1_000_000) + 1
    place = F.xxhash64("doc_id", F.lit(11))
    some = known.where(F.pmod(place, F.lit(1_000_000)) < share).orderBy(place, "doc_id").select("doc_id", F.col("y").cast("int").alias("y")).limit(2 * rows)
    return docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
