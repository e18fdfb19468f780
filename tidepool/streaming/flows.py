"""Structured Streaming forms of the operators that keep state over time.

State is kept in one of two ways. ``cooled`` and ``alive`` keep a value for each key in
Spark's state store, in maps by bucket, with event-time timers that drop it, so state is
bounded by the keys that are active. ``replaced``, ``folded`` and ``fresh`` keep whole results as committed
generations. Both live in the folder that is given, beside the stream's checkpoint: a
stream that is started again with the same folder goes on where it stopped.
"""

from __future__ import annotations

import contextlib
from collections import defaultdict
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from tidepool.sources.domain import Domain
from tidepool.sources.generations import Generations, own_folder

_ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def ticks(events: DataFrame, at: str, minutes: int = 15) -> DataFrame:
    """(at): the aligned intervals in which rows of a stream fall, each once: the runs of a schedule that is replayed over them."""
    step = 60 * minutes
    aligned = events.select(F.timestamp_seconds(F.floor(F.unix_seconds(at) / step) * step).alias("at"))
    return aligned.withWatermark("at", "0 seconds").dropDuplicates(["at"]) if events.isStreaming else aligned.distinct()


def stream(d: Domain, name: str) -> DataFrame:
    """A stored table as a stream of its files; zone-less timestamps are instants in UTC."""
    df = d.spark.read.parquet(f"{d.folder}/{name}.parquet")
    zoneless = [f.name for f in df.schema if f.dataType.typeName() == "timestamp_ntz"]
    return d.spark.readStream.schema(df.schema).parquet(f"{d.folder}/{name}.parquet*").withColumns({c: F.col(c).cast("timestamp") for c in zoneless})


def drained(d: Domain, df: DataFrame, columns: list[str], folder: str | None = None) -> DataFrame:
    """All that a stream gave up to what is there now, as a table."""
    where = folder or own_folder(d.spark)
    query = df.select(*columns).writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return d.spark.read.schema(df.select(*columns).schema).parquet(f"{where}/out")


def _batches(df: DataFrame, where: str, mode: str, put: Callable[[DataFrame, int], None]) -> None:
    df.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start().awaitTermination()


class Rejected(ValueError):
    """A batch with rows that aren't what they should be."""


def replaced(d: Domain, df: DataFrame, folder: str | None = None, valid: Column | None = None, mode: str = "complete") -> DataFrame | None:
    """The result of a stream's last good batch: each batch replaces the whole one before.

    In mode "complete" a batch is an aggregate of all so far, in "append" a snapshot by itself.
    A batch with a row that isn't ``valid`` (false or null) raises, and its stream stops; what
    counts is then the batch before, also after a restart. None before the first good batch.
    """
    where = folder or own_folder(d.spark)
    results = Generations(d.spark, f"{where}/out")

    def put(batch: DataFrame, number: int) -> None:
        staged = results.stage()
        batch.write.parquet(staged)
        kept = d.spark.read.parquet(staged)
        if valid is not None and not kept.where(~F.coalesce(valid, F.lit(False))).isEmpty():
            raise Rejected(f"batch {number}")
        results.publish(number, staged)
        results.drop(*results.numbers()[:-2])

    _batches(df, where, mode, put)
    return results.read()


def last_good(results: Generations, now: Column, expires: str) -> DataFrame | None:
    """The current generation's rows that have not run out; what a reader gets while later batches fail."""
    found = results.read()
    return None if found is None else found.where(F.col(expires) > now)


def folded(d: Domain, df: DataFrame, fold: Callable[[DataFrame | None, DataFrame], DataFrame], folder: str | None = None) -> DataFrame:
    """State over a stream's batches: each batch commits the state that ``fold`` makes of the one before and its own rows.

    The one before is the committed generation below the batch's number, so a batch that
    runs again after a failure starts from the same state, and one that counts already isn't
    folded twice.
    """
    where = folder or own_folder(d.spark)
    states = Generations(d.spark, f"{where}/out")

    def put(batch: DataFrame, number: int) -> None:
        before = states.newest(below=number)
        if states.commit(number, fold(None if before is None else states.read(before), batch)):
            states.drop(*states.numbers()[:-2])

    _batches(df, where, "append", put)
    state = states.read()
    return fold(None, d.spark.createDataFrame([], df.schema)) if state is None else state


def fresh(d: Domain, df: DataFrame, key: str, generation: str, folder: str | None = None) -> DataFrame:
    """Of each key the row of its newest generation; a row of an older one that comes later, even after a restart, is stale."""
    rest = [c for c in df.columns if c != key]

    def fold(before: DataFrame | None, batch: DataFrame) -> DataFrame:
        rows = batch if before is None else before.unionByName(batch)
        return rows.groupBy(key).agg(F.max_by(F.struct(*rest), generation).alias("_of")).select(key, *[F.col(f"_of.{c}").alias(c) for c in rest])

    return folded(d, df, fold, folder)


@contextlib.contextmanager
def _state_store(spark: SparkSession) -> Iterator[None]:
    """Values and timers of keys need a store that can be scanned in order; other streams keep the session's choice."""
    before = spark.conf.get(_ROCKS[0], None)
    spark.conf.set(*_ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_ROCKS[0]) if before is None else spark.conf.set(_ROCKS[0], before)


#: Buckets into which keys are dealt by hash; a checkpoint depends on it.
BUCKETS = 1024


class _Timed(StatefulProcessor):
    """One time for each key, in microseconds; it is dropped once the watermark is ``keep`` microseconds past it.

    The keys of a bucket are one map, read and woken as a whole, since each call of the state
    store is a message to the JVM. A time that the bucket's own newest row shows to be over is
    not stored at all: rows behind the watermark are dropped, so none can come that it holds back.
    """

    def __init__(self, keys: StructType, keep: int):
        self.keys, self.names, self.keep = keys, [*keys.fieldNames(), "_at"], keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getMapState("last", self.keys, "at bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        passed, newest, times = timerValues.getCurrentWatermarkInMs() * 1000, 0, defaultdict(set)
        for r in rows:
            at = r["_at"]
            if passed <= 0 or at > passed:
                times[tuple(r[k] for k in self.names[:-1])].add(at)
                newest = max(newest, r["_watermark"] * 1000)
        if not times:
            return
        kept = self.stored()
        for of, found in times.items():
            before = last = kept.get(of)
            for at in self.passing(found, before):
                last = at
                yield Row(**dict(zip(self.names, (*of, at), strict=True)))
            if last != before and last + self.keep > newest:
                kept[of] = last
                self.last.updateValue(of, (last,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.wake(kept)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        kept, passed = self.stored(), max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        for of in [k for k, last in kept.items() if self.due(last) <= passed]:
            del kept[of]
            self.last.removeKey(of)
        self.wake(kept)
        yield from ()

    def stored(self) -> dict[tuple, int]:
        return {tuple(of): value[0] for of, value in self.last.iterator()}

    def due(self, last: int) -> int:
        return (last + self.keep) // 1000 + 1

    def wake(self, kept: dict[tuple, int]) -> None:
        if kept:
            self.handle.registerTimer(self.due(min(kept.values())))

    def passing(self, times: set[int], last: int | None) -> Iterator[int]:
        """The times that pass, in order; the last of them is kept."""
        raise NotImplementedError

    def close(self) -> None:
        pass


class _Cooldown(_Timed):
    def passing(self, times: set[int], last: int | None) -> Iterator[int]:
        for at in sorted(times):
            if last is None or at - last > self.keep:
                last = at
                yield at


class _Seen(_Timed):
    def passing(self, times: set[int], last: int | None) -> Iterator[int]:
        newest = max(times)
        if last is None or newest > last:
            yield newest


def _timed(df: DataFrame, keys: list[str], at: str, late: str, processor: type[_Timed], seconds: int) -> DataFrame:
    """What passes of a stream's rows; one without a time never does."""
    passed = F.unix_millis(F.col(at) - F.expr(f"INTERVAL '{late}'"))
    sent = df.where(F.col(at).isNotNull()).select(*keys, F.col(at).alias("_time"), F.unix_micros(at).alias("_at"), passed.alias("_watermark"), F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).alias("_bucket"))
    schema = df.select(*keys).schema
    return sent.withWatermark("_time", late).groupBy("_bucket").transformWithState(processor(schema, seconds * 1_000_000), StructType([*schema, StructField("_at", LongType())]), "Append", "EventTime")


def cooled(d: Domain, df: DataFrame, keys: list[str], at: str, seconds: int, folder: str | None = None, late: str = "0 seconds") -> DataFrame:
    """Rows that a cooldown lets through, over all batches of a stream: (keys, at).

    A key's rows go in order within a batch, after the last one that batches before let
    through; that one time is all that is kept of a key, and only until the cooldown is over.
    A row that comes in a later batch, but ``late`` (days or shorter units) behind the newest, is
    dropped; an earlier one than the last let through waits like any within the cooldown.
    """
    where = folder or own_folder(d.spark)
    with _state_store(d.spark):
        out = drained(d, _timed(df, keys, at, late, _Cooldown, seconds), [*keys, "_at"], where)
    return out.select(*keys, F.timestamp_micros("_at").alias(at))


def alive(d: Domain, df: DataFrame, key: str, at: str, seconds: int, folder: str | None = None, late: str = "0 seconds") -> DataFrame:
    """(key, last_seen) of the keys seen within ``seconds`` of the newest row so far, read from the state itself: timers have dropped all others."""
    where = folder or own_folder(d.spark)
    seen = _timed(df, [key], at, late, _Seen, seconds)
    with _state_store(d.spark):
        seen.writeStream.format("noop").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start().awaitTermination()
    state = d.spark.read.format("statestore").option("path", f"{where}/state").option("stateVarName", "last").load()
    kept = state.select(F.col(f"user_map_key.{key}").alias(key), F.col("user_map_value.at").alias("_at"))
    # timers count milliseconds, rows microseconds
    newest = kept.agg((F.max("_at") - seconds * 1_000_000).alias("_after"))
    return kept.join(F.broadcast(newest), F.col("_at") > F.col("_after")).select(key, F.timestamp_micros("_at").alias("last_seen"))  # one row


def identified(events: DataFrame) -> DataFrame:
    """Events with an identity, each identity once; identities of days that the stream has passed are forgotten."""
    key = F.concat(F.lit("event:"), F.col("user_id").cast("string"), F.lit(":"), F.date_format("ts", "yyyy-MM-dd"))
    return events.withColumn("event_key", key).withColumn("event_day", F.date_trunc("day", "ts")).withWatermark("event_day", "1 day").dropDuplicates(["event_key", "event_day"])
