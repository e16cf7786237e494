"""Keyed state of the stream jobs, kept in Spark's state store (RocksDB, checkpointed with the query).

``window_counter`` counts admitted requests per (client, window) and forgets a window when the
watermark passes it; ``waiting_room`` holds rows until a processing-time timer lets them go. A batch
touches the keys it contains and nothing else, so its cost does not grow with the history.

All rows of a key meet in one task. What can be decided without the key's state is therefore decided
before the shuffle: see ``spread_excess`` and ``distinct_values``. Both work on one Arrow batch at a
time, so they hold no more than that. The processors are classes made inside functions, so Spark
sends them by value and no worker has to import this package.
"""

from __future__ import annotations

from typing import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

SPREAD = 64  # groups that a hot key's excess rows are dealt to


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """Each value of ``col`` once per Arrow batch: a hot value is a few rows, not a third of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pc.unique(b.column(0))], [col])

    return df.select(col).mapInArrow(run, f"{col} {df.schema[col].dataType.simpleString()}")


def spread_excess(df: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """Adds ``spread``: 0 for a row among the first ``k`` of its keys in its Arrow batch, in ``order``.
    All others cannot be among the first ``k`` of all rows; they get 1 to SPREAD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place = b.select([*keys, *order]).to_pandas().sort_values([*keys, *order], kind="stable")
            rank = place.groupby(keys, dropna=False, sort=False).cumcount().sort_index().to_numpy()
            spread = [0 if r < k else 1 + i % SPREAD for i, r in enumerate(rank)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(spread, pa.int32())], [*b.schema.names, "spread"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{schema}, spread int")


def _window_counter(permits: int) -> StatefulProcessor:
    class WindowCounter(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.seen = handle.getValueState("seen", "seen long")

        def handleInputRows(self, key, rows, timerValues):
            if key[2]:  # excess rows need no count: their key has used up its permits in this batch
                for r in rows:
                    yield Row(seq=r.seq, admitted=False)
                return
            known = self.seen.get()
            n = known[0] if known else 0
            for r in sorted(rows, key=lambda r: (r.micros, r.seq)):  # at most ``permits`` of each Arrow batch
                if not known:
                    self.handle.registerTimer(r.clock_ms)  # of the window: the same for all its rows
                    known = True
                n += 1
                yield Row(seq=r.seq, admitted=n <= permits)
            self.seen.update((min(n, permits),))

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            self.seen.clear()
            return iter(())

        def close(self):
            pass

    return WindowCounter()


def window_counter(requests: DataFrame, permits: int, keep: str) -> DataFrame:
    """seq, admitted of a stream of requests (seq, client_key, window_us, micros) in arrival order.

    The watermark follows the windows' starts at a distance of ``keep``; it drops requests of windows
    that it has passed, and a window's count with it."""
    clock = requests.select("seq", "client_key", "window_us", "micros")
    limited = spread_excess(clock, ["client_key", "window_us"], ["micros", "seq"], permits)
    # one millisecond more: a window that starts exactly ``keep`` before the newest one is still open
    timed = limited.withColumn("clock", F.timestamp_micros("window_us")).withColumn("clock_ms", F.unix_millis("clock"))
    timed = timed.withWatermark("clock", f"{keep} 1 millisecond")
    return timed.groupBy("client_key", "window_us", "spread").transformWithState(
        _window_counter(permits), "seq long, admitted boolean", "Append", "eventTime")


def _waiting_room(fields: list[str], schema: str, delay_ms: int) -> StatefulProcessor:
    class WaitingRoom(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.row = handle.getValueState("row", schema)

        def handleInputRows(self, key, rows, timerValues):
            for r in rows:
                self.row.update(tuple(r[f] for f in fields))
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + delay_ms)
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            held = self.row.get()
            if held:
                self.row.clear()
                yield Row(**dict(zip(fields, held)))

        def close(self):
            pass

    return WaitingRoom()


def waiting_room(rows: DataFrame, key: str, delay_ms: int) -> DataFrame:
    """The rows of a stream, each ``delay_ms`` of processing time after it came; one row waits per key."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.groupBy(key).transformWithState(_waiting_room(rows.columns, schema, delay_ms), schema, "Append", "processingTime")
