"""Change feeds of workflows: a snapshot of what is known, then each change once, heartbeats, and an end.

Rows say that an item of a workflow has a status at a time. A feed tells each (item, status) of a workflow at its first row, beats
while the workflow is open, and ends with the first row that is terminal; what comes after that isn't told. A workflow without rows
for ``keep`` is forgotten with all that was told of it, so state stays bounded, and rows after that begin anew.

State is held by key: rows that the watermark hasn't passed, the pairs told, and when the workflow began and was last seen. Rows are
told in order of time and id once the watermark has passed them, so a feed doesn't depend on how its rows were dealt over batches, as long
as none is later than the watermark's delay. Timers in event time wake a workflow for its next row, beat or end.
"""
from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from tidemill.session import ship

#: What a feed tells: kind is snapshot, change, heartbeat or end; at is in microseconds since 1970.
EVENT = "workflow bigint, kind string, at bigint, id bigint, item string, status string"
_PENDING = "at bigint, id bigint, item string, status string, terminal boolean"
_PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Feed(StatefulProcessor):
    """One workflow's feed."""

    def __init__(self, keep: int, beat: int) -> None:
        self.keep, self.beat = keep, beat

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", _PENDING)
        self.told = handle.getListState("told", "item string, status string")
        self.open = handle.getValueState("open", "began bigint, last bigint, beats bigint, ended boolean")

    def handleInitialState(self, key: Any, initialState: Any, timerValues: Any) -> None:
        """Takes over what a snapshot told: rows of began, last, ended, item and status."""
        first = initialState.iloc[0]
        self.told.put([(r.item, r.status) for r in initialState.itertuples() if r.item is not None and r.status is not None])
        # Beats of the time that the snapshot covers aren't told any more.
        self.open.update((int(first["began"]), int(first["last"]), max(0, int(first["last"] - first["began"])) // self.beat, bool(first["ended"])))
        self._wake(int(first["last"]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        more, first = [], None
        for batch in rows:
            for r in batch.itertuples(index=False):
                more.append((int(r.at), int(r.id), r.item, r.status, bool(r.terminal)))
                first = more[-1][0] if first is None else min(first, more[-1][0])
        if more:
            self.pending.appendList(more)
            self._wake(first)
        yield from self._tell(key[0], timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield from self._tell(key[0], timerValues.getCurrentWatermarkInMs() * 1000)

    def _wake(self, at: int) -> None:
        self.handle.registerTimer(-(-at // 1000))

    def _tell(self, workflow: int, upto: int) -> Iterator[pd.DataFrame]:
        """Tells what is due up to a time, in order."""
        rows = [tuple(r) for r in self.pending.get()]
        due, left = sorted(r for r in rows if r[0] <= upto), [r for r in rows if r[0] > upto]
        began, last, beats, ended = self.open.get() if self.open.exists() else (None, None, 0, False)
        told = {tuple(r) for r in self.told.get()} if began is not None else set()
        known, out = set(told), []

        def beat(until: int) -> None:
            nonlocal beats
            while not ended and began + (beats + 1) * self.beat < until:
                beats += 1
                out.append((workflow, "heartbeat", began + beats * self.beat, None, None, None))

        for at, id_, item, status, terminal in due:
            if began is not None and at - last > self.keep:
                beat(last + self.keep + 1)
                began = None
            if began is None:
                began, beats, ended, told = at, 0, False, set()
            beat(at)
            last = max(at, last) if last is not None else at
            if ended:
                continue
            if (item, status) not in told:
                told.add((item, status))
                out.append((workflow, "change", at, id_, item, status))
            if terminal:
                ended = True
                out.append((workflow, "end", at, id_, None, status))
        if began is not None:
            beat(min(upto, last + self.keep) + 1)
            if upto - last > self.keep:
                began = None
        if due:
            self.pending.put(left) if left else self.pending.clear()
        if began is None:
            self.told.clear()
            self.open.clear()
        else:
            # Once a workflow has ended, nothing told is needed to keep quiet.
            if ended:
                self.told.clear()
            elif told != known:
                self.told.put(sorted(told, key=repr))
            self.open.update((began, last, beats, ended))
            self._wake(last + self.keep + 1000)
            if not ended:
                self._wake(began + (beats + 1) * self.beat + 1)
        if left:
            self._wake(min(r[0] for r in left))
        if out:
            yield pd.DataFrame(out, columns=["workflow", "kind", "at", "id", "item", "status"]).astype({"id": "Int64"})


def rows_of(df: DataFrame) -> DataFrame:
    """ts, workflow, id, item, status and terminal of ``df`` with at, its time in microseconds."""
    return df.select("ts", F.unix_micros("ts").alias("at"), "workflow", "id", "item", "status", F.coalesce("terminal", F.lit(False)).alias("terminal"))


def snapshot(rows: DataFrame, keep_ms: int) -> DataFrame:
    """What a feed has told of each workflow that is known after ``rows``: workflow, at, id, item, status, began, last and ended.

    A batch over a table, with the same rules: the first row of each (item, status) since the workflow was last forgotten, up to its end.
    Windows run over one workflow's rows.
    """
    order = Window.partitionBy("workflow").orderBy("at", "id")
    new = F.coalesce((F.col("at") - F.lag("at").over(order) > keep_ms * 1000).cast("int"), F.lit(0))
    runs = rows_of(rows).withColumn("_new", new).withColumn("_run", F.sum("_new").over(order))
    mine = Window.partitionBy("workflow")
    runs = runs.withColumn("_last", F.max("_run").over(mine)).where("_run = _last")
    before = F.coalesce(F.max(F.col("terminal").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.withColumn("_over", before).withColumn("began", F.min("at").over(mine)).withColumn("last", F.max("at").over(mine))
    runs = runs.withColumn("ended", F.max(F.col("terminal")).over(mine))
    first = F.row_number().over(Window.partitionBy("workflow", "item", "status").orderBy("at", "id"))
    out = runs.where("_over = 0").withColumn("_first", first).where("_first = 1")
    return out.select("workflow", "at", "id", "item", "status", "began", "last", "ended")


def change_feed(stream: DataFrame, delay: str, keep_ms: int, beat_ms: int, known: DataFrame | None = None) -> DataFrame:
    """The feed (``EVENT``) of a stream of ts, workflow, id, item, status and terminal.

    ``known``: what :func:`snapshot` gave of rows before the stream's; nothing that it has is told again. The session
    must keep its state in RocksDB (:func:`state_provider`).
    """
    ship(stream.sparkSession)
    grouped = rows_of(stream.withWatermark("ts", delay)).groupBy("workflow")
    begin = known.select("workflow", "began", "last", "ended", "item", "status").groupBy("workflow") if known is not None else None
    return grouped.transformWithStateInPandas(Feed(keep_ms * 1000, beat_ms * 1000), EVENT, "append", "EventTime", initialState=begin)


class state_provider:  # noqa: N801 - reads as a verb in a with statement
    """Keeps streams that start in its block in RocksDB, as states with timers need."""

    def __init__(self, spark) -> None:
        self.conf = spark.conf

    def __enter__(self) -> None:
        self.before = self.conf.get(_PROVIDER[0], None)
        self.conf.set(*_PROVIDER)

    def __exit__(self, *_: object) -> None:
        self.conf.set(_PROVIDER[0], self.before) if self.before else self.conf.unset(_PROVIDER[0])
