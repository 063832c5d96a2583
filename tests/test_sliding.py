"""Sliding windows from panes: as a batch, as a stream, and in the plan."""

import collections
import datetime

import pytest
from pyspark.sql import functions as F

from cadenza.streaming import events

START = datetime.datetime(2024, 3, 1, tzinfo=datetime.UTC)


def brute(rows, days=7):
    made = collections.defaultdict(list)
    for ts, kind, v in rows:
        day = ts.date()
        for i in range(days):
            made[day - datetime.timedelta(days=i), kind].append(v)
    return {k: (len(v), pytest.approx(sum(x for x in v if x is not None)) if any(x is not None for x in v) else None) for k, v in made.items()}


def sample(n=400):
    return [(START + datetime.timedelta(hours=(i * 37) % 900, minutes=i % 60), "ab"[i % 3 == 0], None if i % 41 == 0 else float(i)) for i in range(n)] + [(START, "only", None)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "ts timestamp, event_type string, value double")


def test_batch_and_plan(spark):
    rows = sample()
    made = events.sliding(frame(spark, rows))
    got = {(r.window.start.date(), r.event_type): (r.n, r.value) for r in made.collect()}
    assert got == brute(rows)
    # The copies into windows stand above the panes' aggregates.
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Expand") == 1 and plan.index("Expand") < plan.index("count(1)") and "Aggregate" in plan[: plan.index("Expand")]


def test_stream_gives_the_windows_that_have_closed(spark, tmp_path):
    rows = sorted(sample())
    for k in range(4):
        frame(spark, rows[k * 101 : (k + 1) * 101]).coalesce(1).write.parquet(f"{tmp_path}/e/{k}")
    schema = frame(spark, rows).schema
    flow = events.sliding(events.stream(spark, f"{tmp_path}/e/*", schema, files_per_batch=1), late="1 day")
    at = f"{tmp_path}/out"
    for _ in range(2):  # the second run starts from the checkpoint and has nothing to add
        flow.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(at).awaitTermination()
    got = {(r.window.start.date(), r.event_type): (r.n, r.value) for r in spark.read.parquet(at).collect()}
    want = brute(rows)
    assert got and all(want[k] == v for k, v in got.items())
    last = max(ts for ts, _, _ in rows) - datetime.timedelta(days=10)
    assert {k for k in want if k[0] + datetime.timedelta(days=7) <= last.date()} <= got.keys()
    assert spark.read.parquet(at).groupBy("window", "event_type").count().where(F.col("count") > 1).isEmpty()
