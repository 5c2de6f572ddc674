"""Folds over streams of frames, a value of state for each volume, ended by bytes or by time.

Frames of a volume come in order of seq from one micro-batch to the next, in any
order within one; a frame that comes again, as a source that replays sends it, is
left. State and timers are in the query's checkpoint: a query that is started
anew goes on where the last one stopped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

SYNCS = "volume_id long, number long, first_seq long, last_seq long, bytes long, why string"
RUNS = "volume_id long, start long, length long, n_frames long"


class _Fold(StatefulProcessor):
    """One value of state and at most one timer for each volume."""

    STATE = ""

    def __init__(self, after_ms: int | None):
        self.after_ms = after_ms

    def init(self, handle) -> None:
        self.handle, self.state = handle, handle.getValueState("fold", self.STATE)

    def timer(self, now: int | None) -> None:
        """One timer, ``after_ms`` from now; none without now."""
        if self.after_ms is None:
            return
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if now is not None:
            self.handle.registerTimer(now + self.after_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows)).sort_values("seq")
        state = tuple(self.state.get()) if self.state.exists() else self.first()
        out, had = [], self.open(state)
        for frame in got.to_dict("records"):
            if frame["seq"] > state[0]:
                state = self.step(state, frame, out)
        self.state.update(state)
        # The time runs from the first frame that is not yet in a sync, or from the last of a run.
        if not self.open(state):
            self.timer(None)
        elif out or not had or self.idle:
            self.timer(timerValues.getCurrentProcessingTimeInMs())
        yield self.frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        if self.state.exists() and self.open(state := tuple(self.state.get())):
            self.state.update(self.expired(state, out))
        yield self.frame(key, out)

    def frame(self, key, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(int(key[0]), *r) for r in out], columns=self.COLUMNS)

    def close(self) -> None:
        pass


class Syncs(_Fold):
    """State: last seq, number of the next sync, first seq not in one, bytes not in one."""

    STATE = "last long, number long, first long, held long"
    COLUMNS = ("volume_id", "number", "first_seq", "last_seq", "bytes", "why")
    idle = False

    def __init__(self, every: int, after_ms: int | None):
        super().__init__(after_ms)
        self.every = every

    @staticmethod
    def first() -> tuple:
        return (-1, 0, -1, 0)

    @staticmethod
    def open(state: tuple) -> bool:
        return state[2] >= 0

    def step(self, state: tuple, frame: dict, out: list) -> tuple:
        seq, (_, number, first, held) = int(frame["seq"]), state
        first, held = (seq if first < 0 else first), held + int(frame["length"])
        if held >= self.every:
            out.append((number, first, seq, held, "bytes"))
            return (seq, number + 1, -1, 0)
        return (seq, number, first, held)

    @staticmethod
    def expired(state: tuple, out: list) -> tuple:
        last, number, first, held = state
        out.append((number, first, last, held, "time"))
        return (last, number + 1, -1, 0)


class ZeroRuns(_Fold):
    """State: last seq, start, end and frames of the open run."""

    STATE = "last long, start long, end long, n long"
    COLUMNS = ("volume_id", "start", "length", "n_frames")
    idle = True

    @staticmethod
    def first() -> tuple:
        return (-1, 0, 0, 0)

    @staticmethod
    def open(state: tuple) -> bool:
        return state[3] > 0

    def step(self, state: tuple, frame: dict, out: list) -> tuple:
        seq, offset, length = int(frame["seq"]), int(frame["offset"]), int(frame["length"])
        _, start, end, n = state
        if n and frame["zero"] and offset == end:
            return (seq, start, end + length, n + 1)
        if n:
            out.append((start, end - start, n))
        return (seq, offset, offset + length, 1) if frame["zero"] else (seq, 0, 0, 0)

    @staticmethod
    def expired(state: tuple, out: list) -> tuple:
        last, start, end, n = state
        out.append((start, end - start, n))
        return (last, 0, 0, 0)


def _folded(frames: DataFrame, processor: _Fold, schema: str) -> DataFrame:
    frames.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    timed = "none" if processor.after_ms is None else "processingTime"
    return frames.groupBy("volume_id").transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode=timed)


def syncs(frames: DataFrame, every: int, after_ms: int | None = None) -> DataFrame:
    """(volume_id, number, first_seq, last_seq, bytes, why): a sync, or a checkpoint, after the frame (volume_id, seq, length) with which ``every`` bytes have come since the last one, or ``after_ms`` after the first frame that is in none; why: bytes or time. What neither has ended stays in the state."""
    return _folded(frames, Syncs(every, after_ms), SYNCS)


def zero_runs(frames: DataFrame, after_ms: int | None = None) -> DataFrame:
    """(volume_id, start, length, n_frames): runs of zero frames (volume_id, seq, offset, length, zero) that follow each other in order and in place, across batches; a run ends with data, with a gap, or ``after_ms`` after its last frame."""
    return _folded(frames, ZeroRuns(after_ms), RUNS)


def appended(stream: DataFrame, top: str, name: str) -> DataFrame:
    """Run a stream until all that is there is read, append what it gives to a table under ``top``, and read that. Called again, it goes on from its checkpoint.

    Batches without data are off meanwhile, as a stream with timers would have
    them without end: timers that are due go off with the next data. A stream
    that runs on has such batches, and its timers need no data.
    """
    conf, idle = stream.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(idle)
    conf.set(idle, "false")
    try:
        query = stream.writeStream.format("parquet").option("path", f"{top}/{name}").option("checkpointLocation", f"{top}/{name}-log").trigger(availableNow=True).start()
    finally:
        conf.set(idle, before)
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{top}/{name}")


def frames_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A growing folder of Parquet files of frames, below which any folder counts."""
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(folder)
