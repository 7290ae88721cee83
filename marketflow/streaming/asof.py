"""The as-of join of two streams: a keyed state holds what the watermark has not passed, timers emit what it has."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, LongType, StringType, StructType

#: at: time in milliseconds; tie: order of quotes of one time; event: whether it is one, else a quote; body: the columns, as JSON.
HELD = pa.schema([("at", pa.int64()), ("tie", pa.int64()), ("event", pa.bool_()), ("body", pa.string())])
CELL, CHUNK = StructType().add("cell", LongType()), StructType().add("cell", LongType()).add("chunk", LongType())
FOUND = StructType().add("keys", StringType()).add("left", StringType()).add("asof_time", LongType()).add("right", StringType())
#: Rows that a task gathers before it deals them to cells.
GATHERED = 100_000


def _packed(rows: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, rows.schema) as to:
        to.write_table(rows)
    return out.getvalue().to_pybytes()


class LastQuote(StatefulProcessor):
    """State of a key: events and quotes beyond the watermark in cells of time, and the last quote of the cells that it has passed.
    An event is emitted once, when the watermark has passed its time, with the last quote that had come by then; so the state's size follows
    the watermark's delay, and a task holds one cell of a key at a time, whatever the delay."""

    def __init__(self, cell_ms: int) -> None:
        self.size = cell_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cells = handle.getMapState("cells", CELL, StructType().add("chunks", LongType()))
        self.held = handle.getMapState("held", CHUNK, StructType().add("rows", BinaryType()))
        self.last = handle.getValueState("last", StructType().add("at", LongType()).add("body", StringType()))

    def _add(self, parts: list[pa.Table]) -> None:
        rows = pa.concat_tables(parts)
        cell = rows.column("at").to_numpy() // self.size
        order = np.argsort(cell, kind="stable")
        names, first = np.unique(cell[order], return_index=True)
        for c, place in zip(names.tolist(), np.split(order, first[1:]), strict=True):
            n = self.cells.getValue((c,))[0] if self.cells.containsKey((c,)) else 0
            self.held.updateValue((c, n), (_packed(rows.take(pa.array(place))),))
            self.cells.updateValue((c,), (n + 1,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first, parts, n = None, [], 0
        for batch in rows:
            if not len(batch):
                continue
            parts.append(pa.Table.from_pandas(batch[HELD.names], HELD, preserve_index=False))
            n += len(batch)
            least = int(batch["at"].min())
            first = least if first is None else min(first, least)
            if n >= GATHERED:
                self._add(parts)
                parts, n = [], 0
        if parts:
            self._add(parts)
        if first is not None:
            self.handle.registerTimer(first)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        chunks = sorted((k[0], v[0]) for k, v in self.cells.iterator())
        ahead = [c * self.size for c, _ in chunks if c * self.size > now][:1]
        for cell, n in chunks:
            if cell * self.size > now:
                break
            rows = pa.concat_tables([pa.ipc.open_stream(bytes(self.held.getValue((cell, i))[0])).read_all() for i in range(n)])
            rows = rows.sort_by([("at", "ascending"), ("tie", "ascending")])
            at, event = rows.column("at").to_numpy(), rows.column("event").to_numpy()
            quotes, done = np.flatnonzero(~event), np.flatnonzero(event & (at <= now))
            before = self.last.get() if self.last.exists() else (None, None)
            if len(done):
                place = np.searchsorted(at[quotes], at[done], "right") - 1
                body = rows.column("body")
                right = pa.array([before[1], *body.take(pa.array(quotes)).to_pylist()], pa.string()).take(pa.array(place + 1))
                time = pa.array([before[0], *at[quotes].tolist()], pa.int64()).take(pa.array(place + 1))
                yield pd.DataFrame({"keys": [key[0]] * len(done), "left": body.take(pa.array(done)).to_pylist(), "asof_time": pd.array(time.to_pylist(), "Int64"), "right": right.to_pylist()})
            past = quotes[at[quotes] <= now]
            if len(past):
                i = int(past[-1])
                self.last.update((int(at[i]), rows.column("body")[i].as_py()))
            for i in range(n):
                self.held.removeKey((cell, i))
            left = np.flatnonzero(at > now)
            if len(left):  # of the cell that the watermark lies in
                self.held.updateValue((cell, 0), (_packed(rows.take(pa.array(left))),))
                self.cells.updateValue((cell,), (1,))
                ahead = [int(at[left[0]])]
            else:
                self.cells.removeKey((cell,))
        if ahead:
            self.handle.registerTimer(ahead[0])

    def close(self) -> None:
        pass


def stream_asof(events: DataFrame, quotes: DataFrame, by: list[str], time: str, take: list[str], tie: str, late: str = "1 hour", cell_ms: int = 3_600_000) -> DataFrame:
    """events with asof_time and the columns `take` of the last quote of their key at or before them; null where there is none.

    Both are streams with `time` in milliseconds, and one watermark over both, `late` behind the newest row. Rows at or behind
    the watermark when they come are dropped. Among quotes of one time the greatest tie wins. For append mode.
    cell_ms: what a key's task holds at once.
    """
    keys, left, right = (F.struct(*c) for c in (by, events.columns, take))
    row = lambda at_tie, event, body: [F.to_json(keys).alias("keys"), F.col(time).cast("long").alias("at"), at_tie.cast("long").alias("tie"), F.lit(event).alias("event"), F.to_json(body).alias("body")]
    both = events.select(*row(F.lit(0), True, left)).unionByName(quotes.select(*row(F.col(tie), False, right)))
    both = both.withColumn("seen", F.timestamp_millis("at")).withWatermark("seen", late)
    found = both.groupBy("keys").transformWithStateInPandas(LastQuote(cell_ms), FOUND, "append", "eventTime")
    shape = lambda df, names: df.select(*names).schema
    out = found.select(F.from_json("left", shape(events, events.columns)).alias("l"), "asof_time", F.from_json("right", shape(quotes, take)).alias("r"))
    return out.select("l.*", "asof_time", "r.*")
