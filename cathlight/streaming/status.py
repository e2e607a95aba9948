"""Status of keys over a stream of events: keyed state with timers, rejected rows aside, tables by batch number.

Events of a key wait in state until the watermark has passed them, so they are met in the order of their times whatever batch they
came in, and the transitions don't depend on how the stream is cut. A key that is in progress is stalled once nothing came for `stale`; a
timer tells it without another event. State holds a key's events of one watermark delay and one row of status.

A call to the state store costs far more than an event, so a key has a few of them a batch, however many events it has: waiting events are
added and read together, packed into bytes, and one timer tells the first of them.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

STATUS = ("in_progress", "completed", "error")
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WAITING = StructType([StructField("events", BinaryType())])
EVENT = struct.Struct("<qqb")  # time, tie and place in STATUS
NOW = StructType([StructField("status", StringType()), StructField("last", LongType()), StructField("attempts", IntegerType())])
ADDED = 10_000  # events at most that are packed together
OUT = "key string, at long, status string, attempts int"
CHANGE = Row("key", "at", "status", "attempts")


def packed(events: list[tuple[int, int, str]]) -> list[tuple[bytes]]:
    """Events as rows of the waiting list."""
    return [(b"".join(EVENT.pack(at, tie, STATUS.index(status)) for at, tie, status in events[i : i + ADDED]),) for i in range(0, len(events), ADDED)]


def unpacked(rows: Iterable[tuple[bytes]]) -> Iterator[tuple[int, int, str]]:
    """The events of packed rows, in their order."""
    for (events,) in rows:
        for at, tie, place in EVENT.iter_unpack(events):
            yield at, tie, STATUS[place]


class Machine(StatefulProcessor):
    """Transitions of one key; times in milliseconds. A change into in_progress is an attempt."""

    def __init__(self, stale: int):
        self.stale = stale

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now, self.waiting = handle.getValueState("now", NOW), handle.getListState("waiting", WAITING)

    def handleInputRows(self, key, rows, timerValues):
        mark, late, added, first = timerValues.getCurrentWatermarkInMs(), [], [], None
        for row in rows:
            if row.at < mark:  # Spark itself drops what was late a batch ago
                late.append(CHANGE(key[0], row.at, "late", None))
                continue
            added.append((row.at, row.tie, row.status))
            first = row.at if first is None else min(first, row.at)
            if len(added) == ADDED:
                self.waiting.appendList(packed(added))
                added = []
        if added:
            self.waiting.appendList(packed(added))
        if first is not None:
            self.handle.registerTimer(first)
        return iter(late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        mark, out = timerValues.getCurrentWatermarkInMs(), []
        status, last, attempts = self.now.get() or (None, 0, 0)
        waiting = {(at, tie): new for at, tie, new in unpacked(self.waiting.get())}  # the last of the same time and tie
        due = sorted((place, new) for place, new in waiting.items() if place[0] <= mark)
        if due:
            rest = [(at, tie, new) for (at, tie), new in waiting.items() if at > mark]
            if rest:
                self.waiting.put(packed(rest))
                self.handle.registerTimer(min(rest)[0])
            else:
                self.waiting.clear()
        for (at, _), new in due:
            if status == "in_progress" and at - last > self.stale:
                status = "stalled"
                out.append((last + self.stale, status, attempts))
            if new != status:
                attempts += new == "in_progress"
                out.append((at, new, attempts))
            status, last = new, at
        if status == "in_progress" and mark >= last + self.stale:
            status = "stalled"
            out.append((last + self.stale, status, attempts))
        elif status == "in_progress" and due:
            self.handle.registerTimer(last + self.stale)
        if due or out:
            self.now.update((status, last, attempts))
        return iter([CHANGE(key[0], a, s, n) for a, s, n in out])

    def close(self) -> None:
        pass


def transitions(events: DataFrame, key: str, time: str, tie: str, status: Column, stale: int, delay: str) -> DataFrame:
    """A stream of (kind, key, at, status, attempts): changes of status, and as kind `rejected` the rows without key, time, tie or a known status, with what they had.

    at is in milliseconds. Rows that come later than the delay change nothing: they are of the kind `late`, but those that were late a batch ago already, which Spark drops and counts.
    """
    rows = events.select(F.col(key).cast("string").alias("key"), F.col(time).cast("timestamp").alias("_time"), F.unix_millis(F.col(time).cast("timestamp")).alias("at"), F.col(tie).cast("long").alias("tie"), status.alias("status"))
    good = F.coalesce(F.col("key").isNotNull() & F.col("at").isNotNull() & F.col("tie").isNotNull() & F.col("status").isin(*STATUS), F.lit(False))
    timed = rows.withWatermark("_time", delay)
    changed = timed.where(good).groupBy("key").transformWithState(Machine(stale), OUT, "Append", "EventTime")
    bad = timed.where(~good).select(F.lit("rejected").alias("kind"), "key", "at", "status", F.lit(None).cast("int").alias("attempts"))
    return changed.select(F.when(F.col("status") == "late", "late").otherwise("changed").alias("kind"), "key", "at", "status", "attempts").unionByName(bad)


def write_by_batch(stream: DataFrame, folder: str, checkpoint: str, after: Callable[[int], None] = lambda batch: None) -> int:
    """Append all that is available to `folder`/table, a folder a batch and kind; the number of late rows.

    A batch that is run again after a failure replaces what it had written, so the tables are the same as without one.
    """

    def put(batch: DataFrame, number: int) -> None:
        # one write: a second action would run the batch's state again
        batch.write.mode("overwrite").partitionBy("kind").parquet(f"{folder}/table/batch={number}")
        after(number)

    spark = stream.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    try:
        running = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        running.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if before is None else spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    dropped = sum(s["numRowsDroppedByWatermark"] for p in running.recentProgress for s in p["stateOperators"])
    return dropped + status_table(spark, folder, "late").count()


def status_table(spark: SparkSession, folder: str, kind: str = "changed") -> DataFrame:
    """All rows of one kind that were written."""
    return spark.read.schema(f"{OUT}, batch long, kind string").parquet(f"{folder}/table").where(F.col("kind") == kind).drop("batch", "kind")
