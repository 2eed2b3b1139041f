"""Sessions on a stream (T2): exits close a conversation, also when they come late.

The state of a conversation is its first exit's turn and the turn numbers put
out so far, in blocks of ``BLOCK`` turns, kept in the state store and not in the
task. A line is put out when it arrives, unless it stands at or after the known exit. When an earlier
exit arrives later, the lines that were put out after it are retracted. A timer
follows the conversation's newest event time; when the watermark passes it by ``gap`` the
session has timed out and its state is removed.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import ws_trim
from ..operators.agent import EXIT_WORDS
from ..session import ship_package

BLOCK = 256
CHANGES = "conv_id long, turn long, text string, change string"
LINE, RETRACTED = "line", "retracted"


class SessionProcessor(StatefulProcessor):
    """Lines (turn, text, is_exit, at_ms) of one conversation -> changes."""

    def __init__(self, gap_ms: int):
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        # every access is a round trip to the state store, so what is read together is one value
        self.handle = handle
        self.head = handle.getValueState("head", "exit_turn long, newest_ms long")
        self.shown = handle.getMapState("shown", "block long", "turns array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        head = self.head.get()
        exit_turn, before = head if head is not None else (None, None)
        newest, fresh = before, {} if head is None else None
        for part in rows:  # one Arrow batch at a time
            at = int(part["at_ms"].max())
            newest = at if newest is None else max(newest, at)
            exits = part.loc[part["is_exit"], "turn"]
            if len(exits) and (exit_turn is None or int(exits.min()) < exit_turn):
                exit_turn = int(exits.min())
                yield from self._retract(key[0], exit_turn, fresh)
            lines = part[~part["is_exit"]]
            if exit_turn is not None:
                lines = lines[lines["turn"] < exit_turn]
            if len(lines):
                self._show(lines["turn"], fresh)
                yield pd.DataFrame({"conv_id": key[0], "turn": lines["turn"], "text": lines["text"], "change": LINE})
        if newest is not None and (exit_turn, newest) != (head if head is not None else None):
            self.head.update((exit_turn, newest))
            if newest != before:
                if before is not None:
                    self.handle.deleteTimer(before + self.gap_ms)
                self.handle.registerTimer(newest + self.gap_ms)

    def _show(self, turns: pd.Series, fresh: dict | None) -> None:
        """Adds turns to the blocks; ``fresh`` marks a new session, whose blocks not in it are known to be empty."""
        for block, own in turns.groupby(turns // BLOCK):
            known = self.shown.getValue((int(block),)) if fresh is None or block in fresh else None
            self.shown.updateValue((int(block),), (sorted({*(known[0] if known else ()), *own.tolist()}),))
            if fresh is not None:
                fresh[block] = True

    def _retract(self, conv_id: int, exit_turn: int, fresh: dict | None) -> Iterator[pd.DataFrame]:
        if fresh == {}:  # nothing was put out
            return
        first = exit_turn // BLOCK
        for (block,) in [k for k in self.shown.keys() if k[0] >= first]:
            turns = list(self.shown.getValue((block,))[0])
            gone = [t for t in turns if t >= exit_turn]
            if not gone:
                continue
            left = [t for t in turns if t < exit_turn]
            if left:
                self.shown.updateValue((block,), (left,))
            else:
                self.shown.removeKey((block,))
            yield pd.DataFrame({"conv_id": conv_id, "turn": gone, "text": None, "change": RETRACTED})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.head.clear()
        self.shown.clear()
        yield pd.DataFrame({"conv_id": [], "turn": [], "text": [], "change": []}).astype({"conv_id": "int64", "turn": "int64", "text": object, "change": object})

    def close(self) -> None:
        pass


#: Timers and map state need RocksDB. All its stores of an executor share one bound of memory, whatever their number.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Queries started inside keep their state in RocksDB (STATE_STORE); the session's own settings return."""
    before = {name: spark.conf.get(name, None) for name in STATE_STORE}
    for name, value in STATE_STORE.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def session_changes(lines: DataFrame, time_col: str, delay: str = "2 days", gap_seconds: int = 86400) -> DataFrame:
    """A stream of lines (conv_id, turn, text, ``time_col``) -> CHANGES, in update mode (``rocksdb_state``).

    A line later than the watermark (newest time less ``delay``) is dropped by Spark
    and counted in the query's progress. Lines without a conversation, turn or time take no part.
    """
    ship_package(lines.sparkSession)
    text = ws_trim(F.col("text"))
    known = F.col("conv_id").isNotNull() & F.col("turn").isNotNull() & F.col(time_col).isNotNull()
    marked = lines.withWatermark(time_col, delay).where(known).withColumn("text", text).where("text <> ''")
    marked = marked.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "text", time_col,
        F.lower("text").isin(*EXIT_WORDS).alias("is_exit"), F.unix_millis(time_col).alias("at_ms"))
    return marked.groupBy("conv_id").transformWithStateInPandas(SessionProcessor(gap_seconds * 1000), CHANGES, "Update", "EventTime")


def kept_lines(changes: DataFrame) -> DataFrame:
    """The lines of a table of changes that no change retracts."""
    gone = changes.where(F.col("change") == RETRACTED).select("conv_id", "turn").distinct()
    return changes.where(F.col("change") == LINE).join(gone, ["conv_id", "turn"], "left_anti").select("conv_id", "turn", "text")
