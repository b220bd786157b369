"""Streams with state of their own: newest value per key, expiry, and rings of histograms.

Each is a StatefulProcessor over keys. Rows may come in any order within the watermark; state and timers live in the state
store, so a run that is started again from its checkpoint goes on where it stopped. What is sent on are changes; the
functions that read them back give the same rows as the batch operators.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodestone.operators.blockcache import histogram_limits

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _settings(spark: SparkSession, partitions: int | None) -> Iterator[None]:
    wanted = {PROVIDER: STORE} | ({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {})
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run(stream: DataFrame, sink: str, checkpoint: str, partitions: int | None = None) -> None:
    """Appends the changes of what is there now to Parquet, and ends; another run goes on from the checkpoint. `partitions`
    of the state stay as the first run set them."""
    with _settings(stream.sparkSession, partitions):
        stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink).awaitTermination()


def _timed(rows: DataFrame, late: str) -> DataFrame:
    """With the watermark, and the time in microseconds as `us`, whatever the session's time zone."""
    t = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    return t.withColumn("us", F.unix_micros("ts")).withWatermark("ts", late)


class Newest(StatefulProcessor):
    """The newest (ts, ord) and its value for each key, and how many rows the key had."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "at long, ord long, value string, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        at, ord_, value, n = self.newest.get() if self.newest.exists() else (None, None, None, 0)
        for part in rows:
            for t, o, v in zip(part["us"].tolist(), part["ord"].tolist(), part["value"].tolist(), strict=True):
                n += 1
                if at is None or (t, o) > (at, ord_):
                    at, ord_, value = t, o, v
        self.newest.update((at, ord_, value, n))
        yield pd.DataFrame({"key": [key[0]], "at": [at], "ord": [ord_], "value": [value], "n": [n]})

    def close(self) -> None:
        pass


def newest(updates: DataFrame, late: str = "0 seconds") -> DataFrame:
    """A stream (key string, ts, ord long, value string) to changes (key, at, ord, value, n): one for each key and batch."""
    return _timed(updates, late).groupBy("key").transformWithStateInPandas(Newest(), "key string, at long, ord long, value string, n long", "Append", "None")


def newest_now(changes: DataFrame) -> DataFrame:
    """(key, at, value, n) as of the last change of each key."""
    last = changes.groupBy("key").agg(F.max_by(F.struct("at", "value", "n"), "n").alias("x"))
    return last.select("key", "x.at", "x.value", "x.n")


class Expiring(StatefulProcessor):
    """A key lives until its newest row is older than the time to live; a timer for that moment moves with each newer row."""

    def __init__(self, ttl_us: int):
        self.ttl = ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.written = handle.getValueState("written", "at long")

    def _end(self, at: int) -> int:
        """First millisecond at which at + ttl is in the past."""
        return (at + self.ttl) // 1000 + 1

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = self.written.get()[0] if self.written.exists() else None
        at = max(max(part["us"].tolist()) for part in rows if len(part))
        if before is not None and at <= before:
            return
        if before is not None:
            self.handle.deleteTimer(self._end(before))
        self.written.update((at,))
        self.handle.registerTimer(self._end(at))
        yield pd.DataFrame({"key": [key[0]], "at": [at], "expired": [False]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.written.exists():
            (at,) = self.written.get()
            if self._end(at) <= expiredTimerInfo.getExpiryTimeInMs():
                self.written.clear()
                yield pd.DataFrame({"key": [key[0]], "at": [at], "expired": [True]})

    def close(self) -> None:
        pass


def expiring(updates: DataFrame, ttl_seconds: float, late: str = "0 seconds") -> DataFrame:
    """A stream (key string, ts) to changes (key, at, expired). A row is alive as long as its time plus the time to live is
    not before the newest time of the stream, by the millisecond."""
    return _timed(updates, late).groupBy("key").transformWithStateInPandas(Expiring(round(ttl_seconds * 1e6)), "key string, at long, expired boolean", "Append", "EventTime")


def alive_now(changes: DataFrame) -> DataFrame:
    """(key, at) of the keys that no later change has expired."""
    last = changes.groupBy("key").agg(F.max("at").alias("at"), F.max(F.when(F.col("expired"), F.col("at"))).alias("gone"))
    return last.filter("gone IS NULL OR gone < at").select("key", "at")


class Ring(StatefulProcessor):
    """Histograms of the last `count` sub-windows of each key; at the end of a sub-window, their percentiles together."""

    def __init__(self, width_s: int, count: int, percents: list[float]):
        self.width, self.count, self.percents = width_s, count, percents
        self.limits = np.array(histogram_limits(), np.float64)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ring = handle.getMapState("ring", "sub long", "counts binary, n long, total double, least double, greatest double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh: dict[int, list] = {}
        for part in rows:
            sub, v = part["us"].to_numpy(np.int64) // (self.width * 1_000_000), part["v"].to_numpy(np.float64)
            bucket = np.minimum(np.searchsorted(self.limits, v), len(self.limits) - 1)
            for s in np.unique(sub).tolist():
                mine = sub == s
                x = fresh.setdefault(s, [np.zeros(len(self.limits), np.int64), 0, 0.0, np.inf, -np.inf])
                x[0] += np.bincount(bucket[mine], minlength=len(self.limits))
                x[1:] = [x[1] + int(mine.sum()), x[2] + float(v[mine].sum()), min(x[3], float(v[mine].min())), max(x[4], float(v[mine].max()))]
        for s, x in fresh.items():
            if self.ring.containsKey((s,)):
                counts, n, total, least, greatest = self.ring.getValue((s,))
                x = [x[0] + np.frombuffer(counts, np.int64), x[1] + n, x[2] + total, min(x[3], least), max(x[4], greatest)]
            self.ring.updateValue((s,), (x[0].tobytes(), *x[1:]))
            for k in range(self.count):  # the windows that this sub-window is in
                self.handle.registerTimer((s + k + 1) * self.width * 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end = expiredTimerInfo.getExpiryTimeInMs() // (self.width * 1000) - 1
        held = [self.ring.getValue((s,)) for s in range(end - self.count + 1, end + 1) if self.ring.containsKey((s,))]
        if self.ring.containsKey((end - self.count + 1,)):
            self.ring.removeKey((end - self.count + 1,))  # no later window holds it
        if not held:
            return
        counts = np.sum([np.frombuffer(h[0], np.int64) for h in held], axis=0)
        n, total = sum(h[1] for h in held), sum(h[2] for h in held)
        least, greatest = min(h[3] for h in held), max(h[4] for h in held)
        row = {"key": [key[0]], "w": [end], "n": [n], "mean": [round(total / n, 6)], "least": [least], "greatest": [greatest]}
        cum = np.cumsum(counts)
        for p in self.percents:
            need = n * (p / 100)
            i = int(np.argmax((cum >= need) & (counts > 0)))
            lo = self.limits[i - 1] if i else 0.0
            q = lo + (self.limits[i] - lo) * (need - (cum[i] - counts[i])) / counts[i]
            row[f"p{p:g}".replace(".", "_")] = [round(min(max(q, least), greatest), 6)]
        yield pd.DataFrame(row)

    def close(self) -> None:
        pass


def windowed_histograms(values: DataFrame, width_s: int, count: int, percents: list[float], late: str = "0 seconds") -> DataFrame:
    """A stream (key string, ts, v double) to a row for each key and window of `count` sub-windows once it is over."""
    names = ", ".join(f"p{p:g} double".replace(".", "_") for p in percents)
    return _timed(values, late).groupBy("key").transformWithStateInPandas(Ring(width_s, count, percents), f"key string, w long, n long, mean double, least double, greatest double, {names}", "Append", "EventTime")
