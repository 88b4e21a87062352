"""Tables that cut lineage: Parquet in a folder that driver and executors share.

Executors may vanish, so nothing is kept on a single node. What an operator
writes here goes when its block of ``scratch`` ends; without one it stays until
``clear``, as a result that is read later may still need it.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own_dir: list[str] = []
_live: list[Stored] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where none is set: a temporary folder in local mode (tests), an error on a cluster, whose machines wouldn't share it."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="shutterlake-"))
        atexit.register(shutil.rmtree, _own_dir[0], True)
    return f"file://{_own_dir[0]}"


def removed(spark: SparkSession, path: str) -> None:
    """Removes a file or folder of any store that Spark reaches."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Stored:
    """A table written to the shared folder; ``df`` reads it and ``drop`` removes it."""

    def __init__(self, df: DataFrame, what: str):
        spark = df.sparkSession
        self.spark, self.path = spark, f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
        _live.append(self)
        df.write.parquet(self.path)
        self.df = spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        if self in _live:
            _live.remove(self)
        removed(self.spark, self.path)


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written to the shared folder and read again: later stages restart from it."""
    return Stored(df, what).df


@contextmanager
def scratch(*keep: Stored) -> Iterator[list[Stored]]:
    """Tables written inside are dropped at the end, but for those put on the list."""
    before, kept = set(map(id, _live)), list(keep)
    try:
        yield kept
    finally:
        for t in [t for t in _live if id(t) not in before and t not in kept]:
            t.drop()


def clear() -> None:
    """Drops all tables of this process that are still there; results that read them can't be read any more."""
    for t in list(_live):
        t.drop()
