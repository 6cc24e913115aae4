"""Streams: exactly-once samples, hash-ordered shuffling, running packs, bounded queues, staleness, metric roll-ups, event-time windows."""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from brindle.session import scratch


def sample_key(*parts: str) -> Column:
    return F.md5(F.concat_ws("|", *[F.col(p).cast("string") for p in parts]).cast("binary"))


def exactly_once(stream: DataFrame, *keys: str, time: str | None = None, late: str | None = None) -> DataFrame:
    """Each (file, epoch, index) once, also over restarts with the same checkpoint.

    With `time` and `late`, keys older than the watermark leave the state, so it is bounded by the rows of that span;
    without them every key is remembered, which only a finite replay should do.
    """
    if time and late:
        return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))
    return stream.dropDuplicates(list(keys))


class _Buffer(StatefulProcessor):
    """A lane's samples by key in map state. See shuffle_buffer."""

    def __init__(self, capacity: int, random_fetch: float, idle: int | None) -> None:
        self.capacity, self.fetched, self.idle = capacity, int(10_000 * random_fetch), idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getMapState("held", "k string", "v string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        before = {k[0]: v[0] for k, v in self.held.iterator()}
        held, least, out = dict(before), list(before), []
        heapq.heapify(least)
        for pdf in rows:
            for k, v in pdf.sort_values(["o", "k"], kind="stable")[["k", "v"]].itertuples(index=False):
                if k not in held:
                    heapq.heappush(least, k)
                held[k] = v
                if len(held) >= self.capacity or self.fetched and int(k[-16:], 16) % 10_000 < self.fetched:
                    first = heapq.heappop(least)
                    out.append((key[0], first, held.pop(first)))
        for k in before.keys() - held.keys():
            self.held.removeKey((k,))
        for k, v in held.items():
            if before.get(k, held) != v:
                self.held.updateValue((k,), (v,))
        if self.idle is not None:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)
        yield pd.DataFrame(out, columns=["lane", "k", "v"])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        left = sorted((k[0], v[0]) for k, v in self.held.iterator())
        self.held.clear()
        yield pd.DataFrame([(key[0], k, v) for k, v in left], columns=["lane", "k", "v"])

    def close(self) -> None:
        pass


def shuffle_key(epoch: Column, *parts: str) -> Column:
    """Samples of an epoch in hash order, epochs one after the other."""
    return F.concat(F.lpad(epoch.cast("string"), 8, "0"), F.lit("|"), F.substring(sample_key(*parts), 1, 16))


def shuffle_buffer(stream: DataFrame, lane: str, key: str, value: str, capacity: int, order: str, random_fetch: float = 0.0, idle: int | None = None) -> DataFrame:
    """lane, k, v: per lane a buffer of samples by key, a `shuffle_key`. Equal keys overwrite.

    Sends the smallest sample out for each one that fills the buffer to `capacity`, or whose key's hash falls into the
    share `random_fetch`. A lane without input for `idle` milliseconds empties; what is left when a stream ends is `left_in_buffer`.
    Within a micro-batch samples come in the given order. Needs the RocksDB state store, which `drained` sets.
    """
    rows = stream.select(F.col(lane).cast("string").alias("lane"), F.col(key).alias("k"), F.col(value).cast("string").alias("v"), F.col(order).alias("o"))
    return rows.groupBy("lane").transformWithStateInPandas(_Buffer(capacity, random_fetch, idle), "lane string, k string, v string", "append", "none" if idle is None else "processingTime")


def left_in_buffer(spark: SparkSession, checkpoint: str) -> DataFrame:
    """lane, k, v: what the buffers of a finished query hold; a lane's samples leave in the order of k."""
    held = spark.read.format("statestore").option("stateVarName", "held").load(checkpoint)
    return held.select(F.col("key.lane").alias("lane"), F.col("user_map_key.k").alias("k"), F.col("user_map_value.v").alias("v")).sortWithinPartitions("lane", "k")


class _Packs(StatefulProcessor):
    """A lane's open pack. See running_packs."""

    def __init__(self, longest: int) -> None:
        self.longest = longest

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "pack int, items array<long>, used int")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        pack, items, used = self.open.get() if self.open.exists() else (0, [], 0)
        items, out = list(items), []
        for pdf in rows:
            for item, n in sorted(zip(pdf["k"].tolist(), pdf["n"].tolist(), strict=True)):
                items.append(item)
                used += n
                if used >= self.longest:
                    out.append((key[0], pack, ",".join(map(str, items)), self.longest))
                    pack, items, used = pack + 1, [], 0
        self.open.update((pack, items, used))
        yield pd.DataFrame(out, columns=["lane", "pack", "items", "tokens"])

    def close(self) -> None:
        pass


def running_packs(stream: DataFrame, lane: str, key: str, length: str, longest: int) -> DataFrame:
    """Greedy packs per lane that go on over micro-batches: a pack is emitted once it is full; the last ones are `open_packs`."""
    rows = stream.select(F.col(lane).cast("string").alias("lane"), F.col(key).cast("long").alias("k"), F.col(length).cast("int").alias("n"))
    return rows.groupBy("lane").transformWithStateInPandas(_Packs(longest), "lane string, pack int, items string, tokens int", "append", "none")


def open_packs(spark: SparkSession, checkpoint: str) -> DataFrame:
    """lane, pack, items, tokens: packs that were not full when the stream ended."""
    held = spark.read.format("statestore").option("stateVarName", "open").load(checkpoint).select(F.col("key.lane").alias("lane"), "value.*")
    return held.where("size(items) > 0").select("lane", "pack", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"), F.col("used").alias("tokens"))


def rollout_control(stream: DataFrame, lane: str, order: str, kind: str, sample: str, required: int, threshold: float, sync_step: int) -> DataFrame:
    """lane, sample, version, staleness of each sample when it starts, steered by the versions that come in between.

    kind is `submit` (a sample asks to start), `done` (one in flight is finished and queued), `consume` (one leaves the queue)
    or `version` (new parameters). While staleness, the number of samples started since, or the queue is at
    required * (threshold + 1) * sync_step, submitted samples wait. A version resets staleness to those in flight and
    queued; whatever may then start does, in order of submission. Within a micro-batch rows are taken in the given order.
    """
    most = int(required * (threshold + 1) * sync_step)

    def run(lane_key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        version, stale, flying, queued, waiting = state.get if state.exists else (0, 0, 0, 0, [])
        waiting, out = deque(waiting), []
        for pdf in frames:
            for what, item in pdf.sort_values("o", kind="stable")[["kind", "k"]].itertuples(index=False):
                if what == "submit":
                    waiting.append(item)
                elif what == "done" and flying:
                    flying, queued = flying - 1, queued + 1
                elif what == "consume" and queued:
                    queued -= 1
                elif what == "version":
                    version, stale = version + 1, staleness_after_sync(flying, queued)
                while waiting and not must_pause(stale, required, threshold, sync_step) and queued < most:
                    flying, stale = flying + 1, stale + 1
                    out.append((lane_key[0], waiting.popleft(), version, stale))
        state.update((version, stale, flying, queued, list(waiting)))
        yield pd.DataFrame(out, columns=["lane", "sample", "version", "staleness"])

    rows = stream.select(F.col(lane).cast("string").alias("lane"), F.col(order).cast("long").alias("o"), F.col(kind).cast("string").alias("kind"), F.col(sample).cast("long").alias("k"))
    return rows.groupBy("lane").applyInPandasWithState(run, "lane string, sample long, version int, staleness int", "version int, stale int, flying int, queued int, waiting array<long>", "append", GroupStateTimeout.NoTimeout)


def bounded_queue(stream: DataFrame, lane: str, key: str, capacity: int) -> DataFrame:
    """A FIFO per lane that drops its oldest samples when full; emits counters per micro-batch."""

    def run(lane_key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, dropped = state.get if state.exists else ([], 0)
        held = list(held)
        for pdf in frames:
            held += sorted(pdf["k"].tolist())
        lost = max(0, len(held) - capacity)
        held, dropped = held[lost:], dropped + lost
        state.update((held, dropped))
        yield pd.DataFrame({"lane": [lane_key[0]], "queued": [len(held)], "dropped": [dropped]})

    rows = stream.select(F.col(lane).cast("string").alias("lane"), F.col(key).cast("long").alias("k"))
    return rows.groupBy("lane").applyInPandasWithState(run, "lane string, queued int, dropped int", "held array<long>, dropped int", "update", GroupStateTimeout.NoTimeout)


def fresh(df: DataFrame, version: str, current: int, threshold: int) -> DataFrame:
    """Samples whose parameter version lags by at most the threshold: the late-data rule of versioned rollouts."""
    return df.where(F.lit(current) - F.col(version) <= threshold)


def must_pause(stale: int, required: int, threshold: float, sync_step: int) -> bool:
    return stale >= required * (threshold + 1) * sync_step


def staleness_after_sync(in_flight: int, queued: int) -> int:
    return in_flight + queued


def requeued(df: DataFrame, cancelled: Column, order: str) -> DataFrame:
    """`place` in the next round: samples whose rollout was cancelled go first, all in their order."""
    from brindle.operators.batch import with_row_id

    return with_row_id(df.withColumn("_later", F.when(cancelled, 0).otherwise(1)), ["_later", order], "place").drop("_later")


def step_rollup(df: DataFrame, step: str, every: int, name: str, value: str) -> DataFrame:
    """Tumbling windows of `every` steps; works on streams in complete or update mode."""
    return df.groupBy(F.floor(F.col(step) / every).alias("block"), name).agg(F.sum(value).alias("sum"), F.avg(value).alias("avg"), F.max(value).alias("max"), F.min(value).alias("min"), F.count("*").alias("n"))


def rolling(df: DataFrame, order: str, value: str, n: int, *by: str) -> DataFrame:
    """Mean and maximum over each row and the n - 1 before it."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-(n - 1), 0)
    return df.withColumn("rolling_avg", F.avg(value).over(w)).withColumn("rolling_max", F.max(value).over(w))


def event_time(df: DataFrame, column: str) -> DataFrame:
    """A zoned timestamp column, which watermarks need."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def windowed_counts(df: DataFrame, time: str, width: str, slide: str | None, late: str | None, *by: str) -> DataFrame:
    """Tumbling or sliding counts and sums; on streams rows later than `late` are dropped."""
    rows = df.withWatermark(time, late) if late else df
    span = F.window(time, width, slide) if slide else F.window(time, width)
    out = rows.groupBy(span.alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total")


def sessions(df: DataFrame, time: str, gap: str, *by: str) -> DataFrame:
    out = df.groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def appended(start: DataFrame, generate: Callable[[DataFrame], DataFrame], path: str, rounds: int) -> DataFrame:
    """A data set that grows while it is read: at the end of each micro-batch `generate` of it is appended as new files.

    The stream meets them in its next round, with its own checkpoint, so that each row is read once; it ends after `rounds`
    rounds or when nothing was appended. Returns all rows with the micro-batch that read them. A repeated micro-batch
    overwrites what it gave and what it appended.
    """
    spark = start.sparkSession
    start.write.parquet(f"{path}/data/made=-1")
    stream = spark.readStream.schema(start.schema).parquet(f"{path}/data/made=*")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/read/batch={number}")
        held = spark.read.schema(start.schema).parquet(f"{path}/read/batch={number}")
        generate(held).write.mode("overwrite").parquet(f"{path}/data/made={number}")

    for _ in range(rounds):
        query = stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        if query.lastProgress is None or not query.lastProgress.numInputRows:
            break
    return spark.read.schema(f"{', '.join(f'`{c}` {t}' for c, t in start.dtypes)}, batch long").parquet(f"{path}/read")


STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drained(stream: DataFrame, name: str, mode: str = "append", rest: Callable[[SparkSession, str], DataFrame] | None = None) -> DataFrame:
    """Everything that is available now, as a table: for finite replays and tests.

    Rows go to Parquet in the shared folder and never to the driver. A micro-batch has a folder of its own that a repeat
    overwrites; in complete mode the last one is the table. `rest` reads what the finished query's state still holds, which
    comes last.
    """
    spark = stream.sparkSession
    path, store = scratch(spark, name), spark.conf.get(STORE)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    spark.conf.set(STORE, ROCKS)
    try:
        query = stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{path}/state").outputMode(mode).trigger(availableNow=True).start()
        query.awaitTermination()
        if query.exception():
            raise query.exception()
        if query.lastProgress is None:
            return spark.createDataFrame([], stream.schema)
        if rest is not None:
            put(rest(spark, f"{path}/state").select(*stream.columns), query.lastProgress.batchId + 1)
    finally:
        spark.conf.set(STORE, store)
    rows = spark.read.schema(f"{', '.join(f'`{c}` {t}' for c, t in stream.dtypes)}, batch long").parquet(f"{path}/rows")
    if mode == "complete":
        rows = rows.join(F.broadcast(rows.agg(F.max("batch").alias("batch"))), "batch")
    return rows.select(*stream.columns)
