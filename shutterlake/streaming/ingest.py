"""An extension: scan results that arrive as a stream of files are merged into the library batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from shutterlake.operators.library import upsert
from shutterlake.operators.scratch import Stored

#: Parts of the library; a batch rewrites those that it touches.
BUCKETS = 64


class Progress(StreamingQueryListener):
    """The state of merges: query id -> (batches done, rows read, whether it has ended); a query that starts again goes on counting."""

    def __init__(self) -> None:
        self.state: dict[str, tuple[int, int, bool]] = {}

    def onQueryStarted(self, event) -> None:
        batches, rows, _ = self.state.get(str(event.id), (0, 0, False))
        self.state[str(event.id)] = (batches, rows, False)

    def onQueryProgress(self, event) -> None:
        batches, rows, _ = self.state.get(str(event.progress.id), (0, 0, False))
        self.state[str(event.progress.id)] = (batches + 1, rows + event.progress.numInputRows, False)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        batches, rows, _ = self.state.get(str(event.id), (0, 0, False))
        self.state[str(event.id)] = (batches, rows, True)


def bucket(key: str):
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def stream_into_library(spark: SparkSession, incoming: str, schema: str, library: str, checkpoint: str, files_per_batch: int | None = None) -> StreamingQuery:
    """Starts a query that takes all new Parquet files of ``incoming`` and ends; ``files_per_batch`` bounds what is committed at once.

    The library is partitioned by a hash of id (``bucket``). A batch merges into the
    buckets that it touches and replaces those; merged again after a failure it
    gives the same. Of rows of one id in a batch the largest stands.
    """

    def merge(batch: DataFrame, number: int) -> None:
        values = [c for c in batch.columns if c != "id"]
        new = batch.groupBy("id").agg(F.max(F.struct(*values)).alias("v")).select("id", "v.*").withColumn("bucket", bucket("id"))
        new = Stored(new, "batch")
        touched = [r["bucket"] for r in new.df.select("bucket").distinct().collect()]  # at most BUCKETS
        try:
            old = batch.sparkSession.read.schema(new.df.schema).parquet(library).where(F.col("bucket").isin(*touched))
            old.limit(0).count()
        except Exception as missing:  # the first batch
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            old = new.df.limit(0)
        merged = Stored(upsert(old.drop("bucket"), new.df.drop("bucket")).withColumn("bucket", bucket("id")), "merged")
        merged.df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(library)
        for t in (new, merged):
            t.drop()

    reader = spark.readStream.schema(schema)
    rows = (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(incoming)
    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
