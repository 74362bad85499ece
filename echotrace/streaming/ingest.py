"""Structured Streaming ingest: frames that arrive as files, and batches that complete videos.

Back-pressure is Spark's: a trigger takes at most ``files_per_trigger`` files.  A trigger
is written as a whole, and rows that an earlier attempt of it already wrote are left out,
so a restart from the checkpoint gives the batch result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.store import Store

ARRIVING = "video_id int, ts double, mirrored tinyint, embedding array<float>"
BATCHES = "video_id bigint, expected bigint, mirror int, n bigint, ok boolean"
COMPLETED = "video_id bigint, expected bigint, received bigint, n_frames bigint, failed boolean, status string"


def frame_stream(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(ARRIVING).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def write_frames(stream: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """Appends the arriving frames to the store until all files that are there have been taken.

    Each trigger looks for frames that are there already in the buckets of its own videos.
    """

    def append(rows: DataFrame, batch_id: int) -> None:
        key = ["video_id", "ts", "mirrored"]
        rows = rows.dropDuplicates(key).withColumn("ts", F.col("ts").cast("float"))
        buckets = [r[0] for r in rows.select(F.pmod("video_id", F.lit(store.buckets))).distinct().collect()]
        there = store.frames_in(buckets).select(*key)
        store.add_frames(rows.join(there, key, "left_anti").select("video_id", "ts", "mirrored", "embedding"))

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _counter(keep_ms: int | None):
    """A state function: counters of one video; a row once all expected batches came. What comes later changes nothing."""

    def count(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        expected, received, frames, failed, done = state.get if state.exists else (0, 0, 0, False, False)
        for rows in batches:
            if done:
                continue
            expected = max(expected, int(rows["expected"].max()))
            received += len(rows)
            ok = rows["ok"].astype(bool)
            frames += int(rows.loc[ok & (rows["mirror"] == 0), "n"].sum())
            failed = bool(failed or (~ok).any())
        if not done and received >= expected > 0:
            done = True
            yield pd.DataFrame({"video_id": [key[0]], "expected": [expected], "received": [received], "n_frames": [frames], "failed": [failed], "status": ["failed" if failed else "complete"]})
        state.update((expected, received, frames, failed, done))
        if done and keep_ms:
            state.setTimeoutDuration(keep_ms)

    return count


def completed_videos(batches: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """A stream of batch results (BATCHES) to one row for each video, when its last batch comes.

    With keep_ms, the state of a finished video goes that long after its last batch; a
    stream that never ends should set it (one that stops when its input ends must not, as
    Spark then waits for the time to pass).
    """
    state = "expected bigint, received bigint, n_frames bigint, failed boolean, done boolean"
    timeout = GroupStateTimeout.ProcessingTimeTimeout if keep_ms else GroupStateTimeout.NoTimeout
    return batches.groupBy("video_id").applyInPandasWithState(_counter(keep_ms), COMPLETED, state, "append", timeout)


class Progress(StreamingQueryListener):
    """Keeps the row counts and rates of a stream's triggers."""

    def __init__(self):
        self.triggers: list[tuple[int, int, float]] = []

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        self.triggers.append((p.batchId, p.numInputRows, p.processedRowsPerSecond))

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass
