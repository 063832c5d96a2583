from cadenza.sources import files


def test_a_thousand_files_are_one_scan(spark, tmp_path):
    for i in range(1000):
        extra = i % 3 == 0
        name = f"{'old_' if i % 10 == 9 else ''}m{i}_{'liq' if i % 2 else 'oil'}_tpd" if i % 7 else f"m{i}_other_kind"
        head = "y_pred,well,y_true" + (",q10" if extra else "")
        (tmp_path / f"{name}.csv").write_text(f'{head}\r\n{i},"a,{i}",2.5{",1" if extra else ""}\n3,b,\n' + "\n" * (i % 2))
    (tmp_path / "bad_oil_tpd.csv").write_text("well,y_true\na,1\n")
    (tmp_path / "empty_oil_tpd.csv").write_text("")
    df = files.read_result_files(spark, f"{tmp_path}/*.csv", deny=("old_",))
    kept = [i for i in range(1000) if i % 7 and i % 10 != 9]
    got = {(r.model, r.target, r.well): (r.y_true, r.y_pred, r.q10) for r in df.collect()}
    want = {}
    for i in kept:
        model, target = f"m{i}", "liq_tpd" if i % 2 else "oil_tpd"
        want[model, target, f"a,{i}"] = 2.5, float(i), 1.0 if i % 3 == 0 else None
        want[model, target, "b"] = None, 3.0, None
    assert got == want and df.count() == len(want)
    assert set(df.columns) == {"y_pred", "well", "y_true", "q10", "model", "target"}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Union" not in plan


def test_no_files_and_none_that_fit(spark, tmp_path):
    assert files.read_result_files(spark, f"{tmp_path}/*.csv") is None
    (tmp_path / "a_oil_tpd.csv").write_text("x,y\n1,2\n")
    assert files.read_result_files(spark, f"{tmp_path}/*.csv") is None
