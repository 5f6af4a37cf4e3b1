"""The accession ledger as a stream: each accession passes once, over all batches and restarts.

The state is one value for each accession: when it was seen last. With a time to live it goes when that has passed without
the accession coming again, by a timer on event time, so that the state is as large as the accessions of that time.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Ledger(StatefulProcessor):
    """Passes an accession's first row of each life; a timer ends a life."""

    def __init__(self, names: list[str], time: str, live_ms: int):
        self.names, self.time, self.live_ms = names, time, live_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "ends long")

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        import pandas as pd

        every = pd.concat(list(rows), ignore_index=True)
        every = every.sort_values([self.time, *(c for c in self.names if c != self.time)], kind="stable", na_position="last")
        latest = every[self.time].max()
        old = self.seen.get()[0] if self.seen.exists() else None
        ends = (0 if pd.isna(latest) else int(latest.timestamp() * 1000)) + self.live_ms
        if old is None or ends > old:
            if old is not None:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(ends)
            self.seen.update((ends,))
        if old is None:
            yield every.head(1)[self.names]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        self.seen.clear()
        return iter([])

    def close(self) -> None:
        pass


def first_seen(stream: DataFrame, time: str, late: str = "1 hour", live_ms: int = 7 * 86_400_000) -> DataFrame:
    """The stream's rows whose accession has not come within live_ms of event time before; of one batch's rows the earliest.

    The accession is forgotten when the watermark, `late` behind the latest time, has passed its last row by live_ms. Rows
    without an accession are left out. It needs the RocksDB state store: see settings().
    """
    names = stream.columns
    rows = stream.where("accession is not null").withWatermark(time, late)
    return rows.groupBy("accession").transformWithStateInPandas(_Ledger(names, time, live_ms), stream.schema, "append", "EventTime")


def settings(spark) -> None:
    """The state store that first_seen() needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def counts_by_window(stream: DataFrame, time: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Rows and species seen by window of event time."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), "organism").agg(F.count("*").alias("n"))


def run_once(stream: DataFrame, target: str, checkpoint: str, time: str, late: str = "1 hour", live_ms: int = 7 * 86_400_000) -> None:
    """Write the new accessions that have arrived to a Parquet folder, and stop; the checkpoint keeps the ledger."""
    settings(stream.sparkSession)
    seen = first_seen(stream, time, late, live_ms)
    seen.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
