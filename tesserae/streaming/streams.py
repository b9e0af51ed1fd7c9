"""Streaming: latest states of a log, bursts of saves by session windows, gates on micro-batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from tesserae.operators.fingerprint import debounce
from tesserae.operators.gates import enforce

#: State stores that keep state by column family, as transformWithState needs; set it as spark.sql.streaming.stateStore.providerClass.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def latest_states(log: DataFrame, keys: list[str], state: str, ts: str, tie: str) -> DataFrame:
    """The newest state of each key; on a stream use output mode update or complete. Works on tables alike."""
    newest = F.max(F.struct(F.col(ts), F.col(tie), F.col(state))).alias("_n")
    return log.groupBy(*keys).agg(newest).select(*keys, F.col(f"_n.{state}").alias(state), F.col(f"_n.{ts}").alias(ts))


def save_bursts(log: DataFrame, key: str, ts: str, state: str, gap: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """The newest state of each burst of saves whose gaps are at most `gap`; rows later than the watermark are dropped."""
    marked = log.withWatermark(ts, late) if log.isStreaming else log
    runs = marked.groupBy(key, F.session_window(ts, gap).alias("_w")).agg(F.max_by(state, ts).alias(state), F.max(ts).alias(ts), F.count(F.lit(1)).alias("n_saves"))
    return runs.select(key, F.col("_w.start").alias("started"), ts, state, "n_saves")


def gated(stream: DataFrame, gate: Callable[[DataFrame], DataFrame], name: str, sink: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """A writer that hands each micro-batch to sink only if the gate finds nothing in it; findings end the stream."""

    def each(batch: DataFrame, number: int) -> None:
        enforce(gate(batch), name)
        sink(batch, number)

    return stream.writeStream.foreachBatch(each)


class _Debounce(StatefulProcessor):
    """Of one key: rows wait until the watermark has passed them, are judged in order, and a save waits for its run to end."""

    def __init__(self, key: T.DataType, tie: T.DataType, state: T.DataType, kind: T.DataType, gap_micros: int, saves: str):
        row = [T.StructField("us", T.LongType()), T.StructField("tie", tie), T.StructField("state", state), T.StructField("kind", kind)]
        self.row, self.key = T.StructType(row), key
        self.gap, self.saves = gap_micros, saves

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.row)  # later than the watermark
        self.last = handle.getValueState("last", self.row)  # the row before, repeats left out
        self.pending = handle.getValueState("pending", self.row)  # the newest save of a run that may go on

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:  # its columns may go without their names
            found = [tuple(None if x is None or x is pd.NA or x != x else x for x in r) for r in frame.iloc[:, 2:].astype(object).itertuples(index=False)]
            found = [(int(us), *rest) for us, *rest in found]
            if found:
                self.waiting.appendList(found)
                self.handle.registerTimer(-(-min(us for us, *_ in found) // 1000))  # later rows get theirs when this one's has passed
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = [tuple(r) for r in self.waiting.get()]
        due = sorted((r for r in rows if r[0] <= passed), key=lambda r: (r[0], r[1] is None, r[1] if r[1] is not None else 0))
        if due:
            if later := [r for r in rows if r[0] > passed]:
                self.waiting.put(later)
                self.handle.registerTimer(-(-min(r[0] for r in later) // 1000))
            else:
                self.waiting.clear()
        last = tuple(self.last.get()) if self.last.exists() else None
        pending = tuple(self.pending.get()) if self.pending.exists() else None
        out, before = [], (last, pending)
        for r in due:
            if last is not None and r[2] == last[2]:
                continue
            last = r
            if pending is not None and not (r[3] == self.saves and r[0] - pending[0] <= self.gap):
                out.append(pending)
            pending = r if r[3] == self.saves else None
            if pending is None:
                out.append(r)
        if pending is not None and pending[0] + self.gap <= passed:
            out.append(pending)
            pending = None
        if last != before[0]:
            self.last.update(last)
        if pending != before[1]:
            if pending is None:
                self.pending.clear()
            else:
                self.pending.update(pending)
                self.handle.registerTimer(-(-(pending[0] + self.gap) // 1000))
        if out:
            yield pd.DataFrame({"_key": [key[0]] * len(out), "_us": [r[0] for r in out], "_tie": [r[1] for r in out], "_state": [r[2] for r in out], "_kind": [r[3] for r in out]})

    def close(self) -> None:
        pass


def debounced(log: DataFrame, key: str, ts: str, state: str, kind: str, tie: str, gap_seconds: float = 10, saves: str = "save", late: str = "1 minute") -> DataFrame:
    """fingerprint.debounce on a stream: (key, ts, tie, state, kind) of the rows that stay. On a table it is debounce itself.

    A row is judged when the watermark has passed its time, so rows of one key are taken in order of ts and tie however
    the stream delivers them, up to `late`. Repeats of the state before go, saves at most gap_seconds apart are one run,
    whose newest stays once nothing can continue it, and rows of other kinds break runs and all stay. The state of a key
    is its rows within `late`, the last row judged and one save; a restarted query goes on where it ended. Rows later
    than the watermark are dropped, which on a table they aren't. Needs STATE_STORE; output mode append.
    """
    if not log.isStreaming:
        return debounce(log, key, ts, state, kind, gap_seconds, saves, tie).select(key, ts, tie, state, kind)
    types = [log.schema[c].dataType for c in (key, tie, state, kind)]
    marked = log.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).select(
        F.col(key).alias("_key"), F.col(ts).alias("_ts"), F.unix_micros(F.col(ts).cast("timestamp")).alias("_us"), F.col(tie).alias("_tie"), F.col(state).alias("_state"), F.col(kind).alias("_kind")
    )
    out = T.StructType([T.StructField("_key", types[0]), T.StructField("_us", T.LongType()), *(T.StructField(n, t) for n, t in zip(("_tie", "_state", "_kind"), types[1:]))])
    judged = marked.groupBy("_key").transformWithStateInPandas(_Debounce(*types, int(gap_seconds * 1_000_000), saves), out, "Append", "EventTime")
    at = F.timestamp_micros("_us")
    at = at.cast(log.schema[ts].dataType)
    return judged.select(F.col("_key").alias(key), at.alias(ts), F.col("_tie").alias(tie), F.col("_state").alias(state), F.col("_kind").alias(kind))
