"""The last lines of each log, kept by a stream: a ring with rising ids, as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SIZE = 2000
OUT = "log string, id long, ts string, level string, line string"
STATE = "last long, ts array<string>, level array<string>, line array<string>"


def rings(lines: DataFrame, size: int = SIZE) -> DataFrame:
    """``lines`` (log, ts, seq, level, line) of a stream as rings: of each log that got lines its last ``size``, numbered on from 1 over all batches.

    Lines of one batch go by ts (text that sorts by time) and seq; blank and null ones are left out and get no
    number. At most a ring and one Arrow batch of a log are held at once.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, *kept = state.get if state.exists else (0, [], [], [])
        fresh, many = None, 0
        for frame in frames:
            frame = frame[frame["line"].fillna("").str.strip() != ""]
            many += len(frame)
            fresh = (frame if fresh is None else pd.concat([fresh, frame])).sort_values(["ts", "seq"], kind="stable").tail(size)
        columns = [[*old, *fresh[c].tolist()][-size:] for old, c in zip(kept, ("ts", "level", "line"), strict=True)]
        last += many
        state.update((last, *columns))
        n = len(columns[0])
        yield pd.DataFrame({"log": [key[0]] * n, "id": range(last - n + 1, last + 1), "ts": columns[0], "level": columns[1], "line": columns[2]})

    return lines.groupBy("log").applyInPandasWithState(step, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def keep_rings(lines: DataFrame, table: str, checkpoint: str, size: int = SIZE) -> StreamingQuery:
    """Writes the rings of all lines that are there to ``table``, a folder for each log. A batch that runs again writes the same."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("log").parquet(table)

    return rings(lines, size).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
