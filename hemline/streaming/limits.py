"""Limits of failing keys as calls arrive, with keyed state in Spark's own state store.

Calls go through two steps. First the rows of a micro-batch are dealt by key and time slice, and every slice of a key
becomes one short row: failures before and after its first and last success, the place where failures in a row
reach the limit inside it, and when its first failures were. However many calls a hot key has, its slices are worked
on by different tasks. Then the slices of a key are folded in order into its state, two counters and whether it has stopped, by
``transformWithState`` over RocksDB: only the keys of a batch are read and written.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STOPS = "key_id bigint, ts timestamp, event_id bigint, stop string"
SLICES = (
    "key_id bigint, slice bigint, failures bigint, succeeded boolean, lead bigint, tail bigint, inner bigint, "
    "at array<bigint>, ids array<bigint>"
)
COUNTERS = "consecutive bigint, total bigint, stopped boolean"
# Seconds of a slice; parts of a batch that are sorted at once, each in one task.
SLICE_SECONDS, PARTS = 60, 64
ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # a commit uploads what changed, not the store
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextlib.contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """A query that starts inside keeps ``values``; the session gets its own back."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def sliced(calls: pa.Table, max_consecutive: int, max_total: int) -> pa.Table:
    """One row for each key and slice of ``calls`` (key_id, slice, at, event_id, ok), in columns ``SLICES``."""
    key, part, at, event = (calls[c].to_numpy() for c in ("key_id", "slice", "at", "event_id"))
    ok = calls["ok"].to_numpy(zero_copy_only=False).astype(bool)
    order = np.lexsort((event, at, part, key))
    key, part, at, event, ok = key[order], part[order], at[order], event[order], ok[order]
    new = np.append(True, (key[1:] != key[:-1]) | (part[1:] != part[:-1]))
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(key))
    fails = np.append(0, np.cumsum(~ok))  # failures before each row
    upto = fails[1:]
    # failures before the last success at or before each row of the same slice
    base = np.where(ok | new, np.where(ok, upto, fails[:-1]), 0)
    base = np.maximum.accumulate(base)
    in_a_row = upto - base
    after_success = np.cumsum(ok) - np.repeat((np.cumsum(ok) - ok)[start], end - start) > 0
    rows = {"key_id": key[start], "slice": part[start], "failures": fails[end] - fails[start]}
    n_ok = np.add.reduceat(ok.astype(np.int64), start) if len(start) else np.empty(0, np.int64)
    rows["succeeded"] = n_ok > 0
    lead = np.add.reduceat((~ok & ~after_success).astype(np.int64), start) if len(start) else n_ok
    rows["lead"], rows["tail"] = lead, in_a_row[end - 1] if len(start) else n_ok
    # number of the failure, within its slice, at which a run that begins in the slice reaches the limit
    hit = ~ok & after_success & (in_a_row >= max_consecutive)
    place = np.where(hit, upto - np.repeat(fails[start], end - start), np.iinfo(np.int64).max)
    inner = np.minimum.reduceat(place, start) if len(start) else n_ok
    rows["inner"] = np.where(inner == np.iinfo(np.int64).max, 0, inner)
    # no key needs more failures than the larger limit to find its stop
    most = max(max_total, max_consecutive)
    kept = np.flatnonzero(~ok & (upto - np.repeat(fails[start], end - start) <= most))
    count = np.minimum(rows["failures"], most)
    # the failure an inner run ends at may lie beyond those kept only when the total stops the key before
    offsets = np.append(0, np.cumsum(count)).astype(np.int32)
    out = {k: pa.array(v) for k, v in rows.items()}
    out["at"] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(at[kept]))
    out["ids"] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(event[kept]))
    return pa.table(out)


def fold(state: tuple[int, int], slice_, max_consecutive: int, max_total: int):
    """Counters after a slice, and (failure of the slice, limit) of the stop if it holds one."""
    consecutive, total = state
    stops = []
    if slice_.lead and consecutive + slice_.lead >= max_consecutive:
        stops.append((max(1, max_consecutive - consecutive), 0, "consecutive"))
    elif slice_.inner:
        stops.append((slice_.inner, 0, "consecutive"))
    if total + slice_.failures >= max_total:
        stops.append((max(1, max_total - total), 1, "total"))
    after = (slice_.tail if slice_.succeeded else consecutive + slice_.failures, total + slice_.failures)
    return after, min(stops) if stops and slice_.failures else None


class Limits(StatefulProcessor):
    """Folds the slices of a key into its counters; emits the one call at which the key stops.

    With ``forget_ms`` a key that is silent for so long (processing time) is forgotten by a timer and starts afresh.
    """

    def __init__(self, max_consecutive: int, max_total: int, forget_ms: int | None):
        self.limits, self.forget_ms = (max_consecutive, max_total), forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counters = handle.getValueState("counters", COUNTERS)

    def handleInputRows(self, key, rows, timerValues):
        held = self.counters.get() or (0, 0, False)
        if self.forget_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.forget_ms)
        if held[2]:  # nothing can change any more
            return
        state, stop = (held[0], held[1]), None
        slices = pd.concat(list(rows)).sort_values("slice")
        for s in slices.itertuples(index=False):
            state, found = fold(state, s, *self.limits)
            if found:
                n, _, limit = found
                stop = pd.DataFrame({"key_id": [key[0]], "at": [s.at[n - 1]], "event_id": [s.ids[n - 1]], "stop": [limit]})
                break
        self.counters.update((int(state[0]), int(state[1]), stop is not None))
        if stop is not None:
            yield stop

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.counters.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_failure_runs(
    calls: DataFrame, root: str, checkpoint: str, max_consecutive: int = 10, max_total: int = 50,
    slice_seconds: int = SLICE_SECONDS, parts: int = PARTS, forget_ms: int | None = None,
):
    """First limit each key hits (``STOPS`` under ``root/stops``), found as calls (key_id, ts, event_id, ok) arrive.

    Calls of a batch count in the order of (ts, event_id), those of later batches after them. A run of failures goes on
    across batches until a success. Rows without a key or time are left out; ok null counts as a failure. The rows
    of a batch are sorted in ``parts`` parts, each in the memory of one task. Returns the query that ran, for its progress.
    """
    spark = calls.sparkSession
    at = F.unix_micros("ts")
    placed = calls.filter("key_id IS NOT NULL AND ts IS NOT NULL").select(
        F.col("key_id").cast("bigint").alias("key_id"), F.floor(at / F.lit(slice_seconds * 1_000_000)).alias("slice"), at.alias("at"),
        F.col("event_id").cast("bigint").alias("event_id"), F.coalesce("ok", F.lit(False)).alias("ok"),
    )
    dealt = placed.withColumn("part", F.pmod(F.xxhash64("key_id", "slice"), F.lit(parts)))
    slices = dealt.groupBy("part").applyInArrow(lambda t: sliced(t, max_consecutive, max_total), SLICES)
    stops = slices.groupBy("key_id").transformWithStateInPandas(
        Limits(max_consecutive, max_total, forget_ms), "key_id bigint, at bigint, event_id bigint, stop string", "append",
        "none" if forget_ms is None else "processingtime",
    )
    found = stops.select("key_id", F.timestamp_micros("at").alias("ts"), "event_id", "stop")
    # timers of processing time would keep a run that only works through what has arrived going for ever
    with _settings(spark, ROCKSDB | {"spark.sql.streaming.noDataMicroBatches.enabled": "false"}):
        query = (
            found.writeStream.format("parquet")
            .option("path", f"{root}/stops")
            .option("checkpointLocation", checkpoint)
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
    query.awaitTermination()
    return query


def read_counters(spark: SparkSession, checkpoint: str) -> DataFrame:
    """key_id, consecutive, total and stopped of every key, from the state store."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "counters").load()
    return state.select(F.col("key.key_id").alias("key_id"), "value.*")
