"""Prefix state: the stream against the batch frame and plain Python; late rows, silence and a restart."""

import datetime
import statistics

import pytest
from pyspark.sql import functions as F

from cadenza.streaming import events, prefix

START = datetime.datetime(2024, 3, 1, 6, tzinfo=datetime.UTC)
SHAPE = "ts timestamp, event_type string, value double"
HOLD = 3


def sample():
    """Days of two series; "a" jumps and is silent for a week, "b" ends early; a null value, and a type of nulls alone."""
    made = []
    for d in [*range(14), *range(21, 40)]:
        made += [(START + datetime.timedelta(days=d, hours=h), "a", (100.0 if d >= 25 else 10.0) + (d * 7 + h) % 5) for h in range(3)]
    made += [(START + datetime.timedelta(days=d), "b", float(d % 3)) for d in range(9)]
    made += [(START + datetime.timedelta(days=3), "a", None), (START + datetime.timedelta(days=4), "none", None)]
    return sorted(made, key=lambda r: (r[0], r[1]))


def brute(rows, until):
    days = {}
    for ts, kind, v in rows:
        if v is not None:
            days.setdefault(kind, {}).setdefault(ts.date(), []).append(v)
    out = {}
    for kind, by_day in days.items():
        seen, hit, jump, order = [], 0, 0.0, sorted(d for d in by_day if d < until)
        for i, day in enumerate(order):
            x = sum(by_day[day])
            if len(seen) >= prefix.LEAST and abs(x - statistics.fmean(seen)) > prefix.WIDTH * statistics.pstdev(seen):
                hit, jump = len(seen) + 1, 100 * (x - statistics.fmean(seen)) / max(abs(statistics.fmean(seen)), 1e-9)
            seen.append(x)
            row = (len(seen), pytest.approx(statistics.fmean(seen)), len(seen) - hit, pytest.approx(jump))
            out[kind, day, False] = row
            after = order[i + 1] if i + 1 < len(order) else until
            if (after - day).days > HOLD:
                out[kind, day + datetime.timedelta(days=HOLD), True] = (*row[:2], row[2] + HOLD, row[3])
    return out


def found(df):
    rows = df.collect()
    made = {(r.event_type, r.day, r.frozen): (r.n, r.mean, r.since, r.jump) for r in rows}
    assert len(made) == len(rows)
    return made


def batch(frame, until):
    days = events.daily(frame).select("event_type", F.to_date("window.start").alias("day"), "value").where(F.col("day") < F.lit(until))
    return prefix.silent(prefix.features(days, "event_type", "day", "value"), "event_type", "day", HOLD, F.lit(until))


def test_batch_is_brute_force(spark):
    rows, until = sample(), datetime.date(2024, 4, 20)
    want = brute(rows, until)
    assert found(batch(spark.createDataFrame(rows, SHAPE), until)) == want
    assert {k[0] for k in want if k[2]} == {"a", "b"} and any(v[2] == 0 for v in want.values())
    assert batch(spark.createDataFrame([], SHAPE), until).count() == 0


@pytest.mark.parametrize("batches", [1, 5])
def test_stream_with_late_rows_and_a_restart_is_the_batch(spark, tmp_path, batches):
    rows = sample()
    size = -(-len(rows) // batches)
    parts = [rows[k * size : (k + 1) * size] for k in range(batches)]

    def put(k, part):
        spark.createDataFrame(part, SHAPE).coalesce(1).write.parquet(f"{tmp_path}/e/{k}")

    def run():
        flow = events.stream(spark, f"{tmp_path}/e/*", spark.createDataFrame([], SHAPE).schema)
        return prefix.run_prefix(flow, "1 day", HOLD, at=f"{tmp_path}/s")

    for k, part in enumerate(parts):  # each run starts from the state that the one before left
        put(k, part)
        made = run()
    until = (rows[-1][0] - datetime.timedelta(days=1)).date()
    assert found(made) == brute(rows, until) == found(batch(spark.createDataFrame(rows, SHAPE), until))
    put("late", [(START + datetime.timedelta(days=2), "a", 1e6)])  # a closed day's
    assert found(run()) == brute(rows, until)
