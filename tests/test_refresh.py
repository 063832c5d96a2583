"""The panel from partial states: after each change of the files it is what all files give, and only changed ones are read."""

import os
import shutil
import time

import pytest

from cadenza.sources import refresh, shared, tables


def rows(df):
    return sorted(((r.key, r.block, r.date, r.hours), (r.liq_t, r.oil_t, r.p_res)) for r in df.collect())


def same(a, b):
    assert [k for k, _ in a] == [k for k, _ in b]
    for (_, x), (_, y) in zip(a, b):
        assert x == pytest.approx(y, abs=0.011)


def test_panel_follows_added_replaced_and_removed_files(spark, sf, tmp_path):
    src = tmp_path / "sf"
    src.mkdir()
    for t in ("supplier", "nation", "region", "customer", "orders"):
        shutil.copy(f"{sf}/{t}.parquet", src)
    table = src / "lineitem.parquet"
    table.mkdir()
    parts = spark.read.parquet(f"{sf}/lineitem.parquet").randomSplit([1.0] * 4, seed=1)
    for k, part in enumerate(parts):
        part.coalesce(1).write.parquet(f"file://{tmp_path}/p{k}")
    file = [next(os.path.join(d, f) for d, _, fs in os.walk(tmp_path / f"p{k}") for f in fs if f.endswith(".parquet")) for k in range(4)]

    def put(k, name):
        shutil.copy(file[k], table / f"{name}.tmp")
        os.replace(table / f"{name}.tmp", table / f"{name}.parquet")

    def check(want_read):
        made, read = refresh.refresh(spark, f"file://{src}", f"file://{tmp_path}/state")
        assert [os.path.basename(p) for p in read] == want_read
        assert "l_shipdate" not in made._jdf.queryExecution().analyzed().toString()
        same(rows(made), rows(tables.monthly(spark, f"file://{src}")))

    put(0, "a")
    put(1, "b")
    check(["a.parquet", "b.parquet"])
    check([])
    put(2, "c")
    check(["c.parquet"])
    time.sleep(0.01)
    put(3, "b")
    check(["b.parquet"])
    os.remove(table / "a.parquet")
    check([])
    put(0, "a")  # the same bytes at another time are another version
    check(["a.parquet"])
    # A batch that isn't named as done doesn't count.
    spark.read.parquet(f"file://{tmp_path}/state/states").drop("batch").write.parquet(f"file://{tmp_path}/state/states/batch=broken")
    check([])
    shutil.copy(f"{sf}/nation.parquet", src / "nation.parquet")  # new dimensions: all states are made anew
    check(["a.parquet", "b.parquet", "c.parquet"])


def test_what_is_held_is_made_anew_as_its_source_changes(spark, tmp_path):
    (tmp_path / "x.parquet").write_text("1")
    made = []

    def held():
        return shared.once(spark, "thing", str(tmp_path), lambda: made.append(1) or len(made))

    assert held() == held() == 1
    (tmp_path / "x.parquet").write_text("22")
    assert held() == 2
    (tmp_path / "y.parquet").write_text("1")
    assert held() == held() == 3


def test_forgetting_removes_the_tables(spark, tmp_path):
    df = shared.held(spark, "some", str(tmp_path), lambda: spark.range(3).toDF("a"))
    path = df.inputFiles()[0].rpartition("/")[0]
    assert df.count() == 3 and shared.exists(spark, path)
    shared.forget()
    assert not shared.exists(spark, path)
