"""Fitted operators on series made from known parameters, sources and sinks, and odd rows."""

import time
import zipfile
from datetime import date

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from cadenza.functions import solvers, stats
from cadenza.operators import backtest, ensemble, exchange, panel, selection, signals
from cadenza.sources import files, shared, tables
from cadenza.streaming import events


def test_nnls_and_bounds():
    rng = np.random.default_rng(1)
    for _ in range(30):
        a = rng.normal(size=(40, 4))
        w = np.maximum(rng.normal(size=4), 0)
        assert np.allclose(solvers.nnls(a.T @ a, a.T @ (a @ w)), w, atol=1e-6)
    x = solvers.bounded_lsq(lambda x: np.array([x[0] - 3, 10 * (x[1] - x[0] ** 2)]), np.array([1.0, 1.0]), np.array([0.0, 0.0]), np.array([2.0, 50.0]), 400)
    assert np.allclose(x, [2, 4], atol=1e-3)
    assert np.allclose(solvers.unit_sum(np.zeros(4)), 0.25)


def test_coherence_tells_driven_pairs_from_others():
    rng = np.random.default_rng(3)
    x = np.convolve(rng.normal(size=90), [0.5, 1, 0.5], "same")
    near, p = signals.pair_coherence(x, np.roll(x, 1) + 0.2 * rng.normal(size=90), 1, 39)
    far, q = signals.pair_coherence(x, np.convolve(rng.normal(size=90), [0.5, 1, 0.5], "same"), 1, 39)
    assert near > 0.7 > far and p <= 0.1 < q
    assert signals.pair_coherence(x, np.ones(90), 1, 9) == (None, None)


def test_change_points_are_causal(spark):
    x = [10.0] * 20 + [30.0] * 20
    x = [v + 0.5 * np.sin(3 * k) for k, v in enumerate(x)]
    months = pd.date_range("2000-01-01", periods=40, freq="MS")
    df = spark.createDataFrame([("a", d.date(), float(v)) for d, v in zip(months, x, strict=True)] + [("b", months[0].date(), None)], "key string, date date, v double")
    got = {(r.key, r.date): r for r in signals.change_points(df, "v").collect()}
    assert got["a", months[19].date()].cp_jump == 0.0 and got["b", months[0].date()].cp_months == 0
    late = got["a", months[39].date()]
    assert late.cp_months == 19 and late.cp_jump > 50
    held = signals.frozen(signals.change_points(df, "v"), date(2003, 4, 1), 3).collect()
    assert sorted((r.step, r.cp_months) for r in held) == [(1, 20), (2, 21), (3, 22)]


def test_martingale_grows_with_drift_only(spark):
    rng = np.random.default_rng(4)
    rows = [(m, date(2000, 1 + c, 1), f"k{i}", s, float(rng.normal() * (1 + (m == "drift") * 3 * c))) for m in ("same", "drift") for c in range(8) for i in range(20) for s in range(3)]
    df = spark.createDataFrame(rows, "model string, cutoff date, key string, step int, resid double")
    got = {r.model: r.log10_max for r in exchange.exchangeability(df, "model").collect()}
    assert got["drift"] > 2 > got["same"]


@pytest.mark.parametrize("small", [10_000, 20])
def test_order_statistics_are_numpy_s(spark, small):
    rng = np.random.default_rng(6)
    sizes = (1, 9, 10, 11, 30, 5000)
    groups = {n: np.round(rng.random(n), 2 if n == 30 else 6) for n in sizes}
    df = spark.createDataFrame([(n, float(x)) for n, v in groups.items() for x in v] + [(9, None)], "g int, v double")
    got = {r.g: (r.n, r.value) for r in stats.order_statistic(df, ["g"], "v", stats.upper_rank(8, 10), 0.8, small=small).collect()}
    assert got == {n: (n, pytest.approx(np.quantile(v, 0.8, method="higher"))) for n, v in groups.items()}
    beyond = {r.g: r.value for r in stats.order_statistic(df, ["g"], "v", lambda n: F.floor(((n + 1) * 8 + 9) / 10), 0.8, small=small).collect()}
    assert beyond[1] is None and all(beyond[n] == pytest.approx(np.sort(v)[int(((n + 1) * 8 + 9) // 10) - 1]) for n, v in groups.items() if n > 1)


def test_ranks_over_all_rows_average_ties(spark):
    rng = np.random.default_rng(7)
    v = np.round(rng.normal(size=3000), 1)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)] + [(-1, None)], "i int, v double").repartition(7)
    got = {r.i: r.rank for r in stats.averaged_rank(df, "v", "rank").collect()}
    assert got.pop(-1) is None and [got[i] for i in range(len(v))] == pd.Series(v).rank().tolist()
    assert stats.averaged_rank(df.limit(0), "v", "rank").count() == 0


def test_bags_are_ensemble_selection(spark):
    """Against plain loops: models are added with repeats while the bag's error falls."""
    rng = np.random.default_rng(8)
    rows = [(g, k, *(float(x) for x in rng.normal(size=4))) for g in ("a", "b", "c") for k in range(25)] + [("d", k, 1.0, 0.0, 1.0, 5.0) for k in range(3)]
    df = spark.createDataFrame(rows, "g string, k int, y_true double, m0 double, m1 double, m2 double")
    got = {r.g: (r.n, r.weights) for r in ensemble.bags(df, ["m0", "m1", "m2"], ["g"]).collect()}
    for g in "abcd":
        part = np.array([r[2:] for r in rows if r[0] == g])
        chosen, least = [], np.inf
        while len(chosen) < 30:
            errors = [np.abs(part[:, [1 + j for j in (*chosen, more)]].mean(axis=1) - part[:, 0]).sum() for more in range(3)]
            if least - min(errors) <= 1e-12:
                break
            least = min(errors)
            chosen.append(int(np.argmin(errors)))
        assert got[g] == (len(part), pytest.approx([chosen.count(j) / len(chosen) for j in range(3)]))


def test_panel_is_made_once_and_forgotten(spark, sf):
    shared.forget()
    a, b = tables.panel(spark, sf), tables.panel(spark, sf)
    assert a is b and sorted(map(tuple, a.collect())) == sorted(map(tuple, tables.monthly(spark, sf).collect()))
    for name in ("conf_best_method", "ens_greedy_well", "learning_frame"):
        assert __spark_entry__.queries()[name](spark, sf)._jdf.queryExecution().analyzed().toString().count("l_orderkey") == 0
    shared.forget()
    assert tables.panel(spark, sf) is not a


def _workbook(path, sheets):
    """A workbook by hand: numbers as such, texts shared or in place."""
    texts = sorted({c for rows in sheets.values() for r in rows for c in r if isinstance(c, str)})
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'

    def cell(ref, c):
        if isinstance(c, str):
            return f'<c r="{ref}" t="s"><v>{texts.index(c)}</v></c>' if len(c) % 2 else f'<c r="{ref}" t="inlineStr"><is><t>{c}</t></is></c>'
        return f'<c r="{ref}"/>' if c is None else f'<c r="{ref}"><v>{c}</v></c>'

    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f"<workbook {ns}><sheets>" + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><t>{t}</t></si>" for t in texts) + "</sst>")
        for i, rows in enumerate(sheets.values()):
            body = "".join("<row>" + "".join(cell(f"{chr(65 + k)}{n + 1}", c) for k, c in enumerate(r)) + "</row>" for n, r in enumerate(rows))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")


def test_workbooks_arrays_and_result_files(spark, tmp_path):
    monthly = [["title"], ["well", "date", "liq", "name"], [12, 36526, 1.5, "ab"], ["13", "2000-02-01", None, "abc"], [None, None, None, None]]
    _workbook(tmp_path / "book.xlsx", {"MODEL": monthly, "coords": [["well", "x"], [12, 0.25]]})
    got = files.read_sheet(spark, f"{tmp_path}/book.xlsx", "MODEL", "well int, date date, liq double, name string, absent string", skip=1).collect()
    assert sorted(map(tuple, got)) == [(12, date(2000, 1, 1), 1.5, "ab", None), (13, date(2000, 2, 1), None, "abc", None)]
    assert [tuple(r) for r in files.read_sheet(spark, f"{tmp_path}/book.xlsx", "coords", "well string, x double").collect()] == [("12", 0.25)]
    with pytest.raises(Exception, match="no sheet"):
        files.read_sheet(spark, f"{tmp_path}/book.xlsx", "none", "well int").collect()
    np.save(tmp_path / "run.npy", np.arange(12.0))
    assert sorted((r.name, r.step, r.series, r.value) for r in files.read_npy(spark, f"{tmp_path}/*.npy", 3, 2).collect()) == [("run", s, c, 4.0 * (s - 1) + c) for s in (1, 2, 3) for c in (0, 1)]
    for name, text in {"a_b_oil_tpd": "y_true,y_pred,q10,q90\n1,2,0,3\n", "c_liq_tpd": "y_true,y_pred\n4,5\n", "old_x_oil_tpd": "y_true,y_pred\n1,1\n", "d_oil_tpd": "y_true\n1\n", "e_gas_tpd": "y_true,y_pred\n1,1\n"}.items():
        (tmp_path / f"{name}.csv").write_text(text)
    rows = files.read_result_files(spark, f"{tmp_path}/*.csv", deny=("old_",))
    assert sorted(((r.model, r.target, r.y_true, r.q10) for r in rows.collect()), key=repr) == [("a_b", "oil_tpd", 1.0, 0.0), ("c", "liq_tpd", 4.0, None)]
    assert {r.model: r.coverage_80 for r in selection.available_metrics(rows).collect()} == {"a_b": 1.0, "c": None}
    assert selection.available_metrics(rows.drop("q10")).where("coverage_80 is not null").count() == 0
    assert files.read_result_files(spark, f"{tmp_path}/none*.csv") is None


def test_panel_of_two_keys(spark):
    months = pd.date_range("2000-01-01", periods=14, freq="MS")
    rows = [("a", d.date(), None if k in (0, 5) else 10.0 * k, 1.0 if k else None) for k, d in enumerate(months)] + [("b", months[3].date(), 0.0, 1.0)]
    df = spark.createDataFrame(rows, "key string, date date, v double, weff double")
    whole = panel.complete(df)
    assert whole.count() == 28
    filled = {(r.key, r.date.month, r.date.year): r.filled for r in panel.fill(whole, "v", backward=True).collect()}
    assert filled["a", 1, 2000] == 10.0 and filled["a", 6, 2000] == 40.0 and filled["b", 1, 2000] == 0.0
    line = {(r.key, r.date.month, r.date.year): r.filled for r in panel.interpolate(whole, "v").collect()}
    assert line["a", 6, 2000] == pytest.approx(50.0)
    assert panel.started(whole, "v").where("key = 'b' and date < '2000-04-01' and v is not null").count() == 0
    with pytest.raises(Exception, match="duplicate rows"):
        panel.assert_unique(df.union(df), "key", "date").collect()
    assert backtest.naive(df.limit(0), [date(2001, 1, 1)], "v").count() == 0


def test_sources_and_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(date(2000, 1, 1), "a", 1.5), (date(2000, 1, 1), "b", 2.5), (date(2000, 2, 1), "a", 3.5)], "date date, key string, value double")
    tables.write_matrix(rows, f"{tmp_path}/wide", ["a", "b"])
    assert {tuple(r) for r in tables.read_matrix(spark, f"{tmp_path}/wide").collect()} == {tuple(r) for r in rows.collect()}
    tables.write_results(rows.select("*", F.lit("m1").alias("model"), F.lit("t").alias("target")).union(rows.select("*", F.lit("old_m").alias("model"), F.lit("t").alias("target"))), f"{tmp_path}/out")
    assert tables.read_results(spark, f"{tmp_path}/out", ("old_",)).count() == 3
    assert tables.exists(spark, f"{tmp_path}/out") and tables.first_existing(spark, f"{tmp_path}/none", f"{tmp_path}/out") == f"{tmp_path}/out"
    assert tables.read_csv(spark, f"{tmp_path}/wide", "date date, a double, b double").count() == 2


def test_late_events_are_dropped_and_sessions_close(spark, tmp_path):
    rows = [(1, "x", "2024-01-01 00:00:00", 1.0), (1, "x", "2024-01-01 05:00:00", 2.0), (1, "x", "2024-01-01 12:00:00", 4.0), (2, "x", "2024-01-02 00:00:00", 8.0)]
    df = spark.createDataFrame(rows, "user_id long, event_type string, at string, value double").withColumn("ts", F.to_timestamp("at"))
    assert sorted((r.user_id, r.n) for r in events.sessions(df).collect()) == [(1, 1), (1, 2), (2, 1)]
    df.write.parquet(f"{tmp_path}/e")
    got = events.run_available(events.stream(spark, f"{tmp_path}/e", df.schema), "1 day").collect()
    assert sorted((r.n, r.value) for r in got) == [(1, 8.0), (3, 7.0)]


def test_watermark_drops_what_comes_too_late(spark, tmp_path):
    def write(name, *rows):
        df = spark.createDataFrame(rows, "event_type string, at string, value double").withColumn("ts", F.to_timestamp("at"))
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
        return df.schema

    schema = write("e/a", ("x", "2024-01-01 01:00:00", 1.0), ("x", "2024-01-09 01:00:00", 2.0))
    time.sleep(1.1)  # files are taken by their times
    write("e/b", ("x", "2024-01-09 05:00:00", 4.0))
    time.sleep(1.1)
    write("e/c", ("x", "2024-01-01 02:00:00", 8.0), ("x", "2024-01-08 02:00:00", 16.0))
    made = events.run_available(events.stream(spark, f"{tmp_path}/e/*", schema, files_per_batch=1), "2 days").collect()
    assert sorted((str(r.start)[:10], r.n, r.value) for r in made) == [("2024-01-01", 1, 1.0), ("2024-01-08", 1, 16.0), ("2024-01-09", 2, 6.0)]
    (tmp_path / "none").mkdir()
    assert events.run_available(events.stream(spark, f"{tmp_path}/none", schema), "2 days").count() == 0
