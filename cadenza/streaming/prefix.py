"""What a series' past says at each of its days: prefix statistics and a causal level test, as a stream and as a batch.

A day's value deviates if it lies further from the mean of the days before than ``WIDTH`` of their standard deviations
(and a share ``SLACK`` of the mean, above the rounding of the sums), once there are ``LEAST`` of them. A day's features are the days so far, their mean, the days since the last deviation
(all of them where there was none) and its jump in percent of the mean before it. After ``hold`` days without a value
the features are frozen: one more row, in which days go on counting and the rest stays.

The stream aggregates events to days first, so the state sees a row a key and day, however hot the key; closed days come
in order, since the watermark lets none come later. The batch frame takes the same rows through windows.
Days without a known value are no days; a null key is a key of its own; an empty table gives no rows.
"""

from __future__ import annotations

import datetime
import math
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..sources.shared import shared_dir
from ..sources.tables import exists
from .events import daily

WIDTH, LEAST, SLACK = 2.0, 5, 1e-6
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _mean_and_deviation(n: Column, total: Column, squares: Column) -> tuple[Column, Column]:
    mean = total / n
    return mean, F.sqrt(F.greatest(squares / n - mean * mean, F.lit(0.0)))


def features(rows: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """(key, at, n, mean, since, jump) of each row with a value, from the rows up to it; (key, at) is unique."""
    order = Window.partitionBy(key).orderBy(at)
    before, upto = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    x = F.col(value).cast("double")
    past = rows.where(F.col(value).isNotNull()).select(
        key, at, x.alias("x"), F.row_number().over(order).alias("n"), F.sum(x).over(before).alias("total"), F.sum(x * x).over(before).alias("squares")
    )
    mean, deviation = _mean_and_deviation(F.col("n") - 1, F.col("total"), F.col("squares"))
    deviates = (F.col("n") > LEAST) & (F.abs(F.col("x") - mean) > WIDTH * deviation + SLACK * F.abs(mean))
    jump = 100 * (F.col("x") - mean) / F.greatest(F.abs(mean), F.lit(1e-9))
    tested = past.select(key, at, "n", ((F.coalesce("total", F.lit(0.0)) + F.col("x")) / F.col("n")).alias("mean"), F.when(deviates, F.col("n")).alias("hit"), F.when(deviates, jump).alias("size"))
    last = lambda c: F.last(c, ignorenulls=True).over(upto)
    return tested.select(key, at, "n", "mean", (F.col("n") - F.coalesce(last("hit"), F.lit(0))).alias("since"), F.coalesce(last("size"), F.lit(0.0)).alias("jump"))


def silent(made: DataFrame, key: str, at: str, hold: int, until: Column) -> DataFrame:
    """The features and, where no later day comes within ``hold`` days, before the day ``until``, their frozen rows."""
    after = F.lead(at).over(Window.partitionBy(key).orderBy(at))
    quiet = F.datediff(F.coalesce(after, until), F.col(at)) > hold
    both = F.filter(F.array(F.lit(False), F.lit(True)), lambda f: ~f | F.col("_quiet"))
    copied = made.withColumn("_quiet", quiet).withColumn("frozen", F.explode(both))
    return copied.select(key, F.when(F.col("frozen"), F.date_add(at, hold)).otherwise(F.col(at)).alias(at), "n", "mean", (F.col("since") + F.when(F.col("frozen"), hold).otherwise(0)).alias("since"), "jump", "frozen")


class Prefix(StatefulProcessor):
    """One key's prefix state: a row of sums, whatever the length of the series, and a timer for its silence."""

    SHAPE = "n bigint, total double, squares double, hit bigint, jump double, day date, frozen boolean"

    def __init__(self, key: str, hold: int) -> None:
        self.key, self.hold = key, hold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("prefix", self.SHAPE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802
        n, total, squares, hit, jump, day, frozen = self.state.get() if self.state.exists() else (0, 0.0, 0.0, 0, 0.0, None, False)
        for r in sorted(rows, key=lambda r: r.day):
            if n and not frozen and (r.day - day).days > self.hold:
                yield self._row(key, day, n, total, hit, jump, True)
            if n >= LEAST:
                mean = total / n
                if abs(r.value - mean) > WIDTH * math.sqrt(max(squares / n - mean * mean, 0.0)) + SLACK * abs(mean):
                    hit, jump = n + 1, 100 * (r.value - mean) / max(abs(mean), 1e-9)
            n, total, squares, day, frozen = n + 1, total + r.value, squares + r.value * r.value, r.day, False
            yield self._row(key, day, n, total, hit, jump, False)
        self.state.update((n, total, squares, hit, jump, day, frozen))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        ends = datetime.datetime.combine(day + datetime.timedelta(days=self.hold + 1), datetime.time(), datetime.UTC)
        self.handle.registerTimer(int(ends.timestamp() * 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802
        n, total, squares, hit, jump, day, frozen = self.state.get()
        if not frozen:
            self.state.update((n, total, squares, hit, jump, day, True))
            yield self._row(key, day, n, total, hit, jump, True)

    def _row(self, key, day, n, total, hit, jump, frozen: bool) -> Row:
        quiet = self.hold if frozen else 0
        return Row(**{self.key: key[0]}, day=day + datetime.timedelta(days=quiet), n=n, mean=total / n, since=n - hit + quiet, jump=jump, frozen=frozen)

    def close(self) -> None:
        pass


def shape(events: DataFrame, key: str) -> str:
    return f"`{key}` {events.schema[key].dataType.simpleString()}, day date, n bigint, mean double, since bigint, jump double, frozen boolean"


def prefix_state(events: DataFrame, late: str, hold: int, key: str = "event_type") -> DataFrame:
    """The stream of features of each key's days. It needs the RocksDB state store, days in UTC and append mode."""
    days = daily(events, late, key).where("value is not null")
    closed = days.select(key, F.window_time("window").alias("ts"), F.to_date("window.start").alias("day"), "value")
    return closed.groupBy(key).transformWithState(Prefix(key, hold), shape(events, key), "Append", "EventTime")


def run_prefix(events: DataFrame, late: str, hold: int, key: str = "event_type", at: str | None = None) -> DataFrame:
    """The features of a stream's closed days, run over the files there are, from a table in the shared folder.

    With a folder given, its table and state are gone on with."""
    spark = events.sparkSession
    at = at or f"{shared_dir(spark)}/prefix-{uuid.uuid4().hex}"
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        writer = prefix_state(events, late, hold, key).writeStream.format("parquet").outputMode("append")
        query = writer.option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start(f"{at}/out")
    finally:
        spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)
    query.awaitTermination()
    made = shape(events, key)
    return spark.read.schema(made).parquet(f"{at}/out") if exists(spark, f"{at}/out") else spark.createDataFrame([], made)
