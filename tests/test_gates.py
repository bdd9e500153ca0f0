from strata.operators.gates import gate_summary, run_breaches, run_verdict
from strata.schemas import RUNS_DDL, struct


def _runs(spark, rows):
    # (cycle, reset, e2e, outcome)
    full = [(c, 0, r, 1, 1, 1, 1, e, o, None if o == "pass" else "verify") for c, r, e, o in rows]
    return spark.createDataFrame(full, struct(RUNS_DDL))


def _summary(spark, rows):
    return {r["metric"]: r.asDict() for r in gate_summary(_runs(spark, rows)).collect()}


def test_no_passing_runs_gives_zeros_and_no_pass(spark):
    s = _summary(spark, [(1, 10, 100, "fail"), (2, 20, 200, "fail")])
    assert s["m1"]["min"] == 0 and s["m1"]["max"] == 0 and s["m1"]["p50"] == 0
    assert s["m1"]["all_pass"] is False and s["m1"]["passed_runs"] == 0


def test_even_number_of_passing_runs_takes_the_mean_of_the_middle(spark):
    s = _summary(spark, [(1, 10, 100, "pass"), (2, 20, 200, "pass"), (3, 999, 9999, "fail")])
    assert s["m1"]["p50"] == 15 and s["m2"]["p50"] == 150
    assert (s["m1"]["min"], s["m1"]["max"]) == (10, 20)


def test_exactly_at_the_limit_fails_the_gate(spark):
    s = _summary(spark, [(1, 120, 100, "pass"), (2, 10, 1499, "pass")])
    assert s["m1"]["under_limit"] == 1 and s["m1"]["all_pass"] is False
    assert s["m2"]["all_pass"] is True


def test_verdict_ready_and_not_ready(spark):
    ok = run_verdict(_runs(spark, [(1, 10, 100, "pass"), (2, 30, 300, "pass"), (3, 20, 200, "pass")])).first()
    assert ok["verdict"] == "READY" and ok["blockers"] == "" and ok["flakes"] == 0
    bad = run_verdict(_runs(spark, [(1, 130, 100, "pass"), (2, 10, 100, "fail")])).first()
    assert bad["verdict"] == "NOT READY"
    assert bad["blockers"] == "1 flake(s) detected; m1 gate failed"


def test_grouped_summary_has_a_row_per_group_and_gate(spark):
    runs = _runs(spark, [(1, 10, 100, "pass"), (2, 20, 200, "fail")]).selectExpr(
        "*", "CASE WHEN cycle = 1 THEN 'a' ELSE 'b' END AS batch"
    )
    rows = gate_summary(runs, ["batch"]).collect()
    assert len(rows) == 4
    b = {(r["batch"], r["metric"]): r for r in rows}
    assert b[("b", "m1")]["passed_runs"] == 0 and b[("a", "m1")]["p50"] == 10


def test_fewer_runs_than_asked_for_are_not_ready(spark):
    row = run_verdict(_runs(spark, [(1, 10, 100, "pass")]), expected_cycles=5).first()
    assert row["verdict"] == "NOT READY" and row["m3_pass"] is False
    assert row["blockers"] == "1 of 5 cycles passed"


def test_breaches_list_passing_runs_over_a_limit(spark):
    # A failed run is a flake and ends before its durations are looked at.
    runs = _runs(spark, [(1, 120, 1501, "pass"), (2, 121, 100, "fail"), (3, 121, 100, "pass")])
    got = {(r["cycle"], r["metric"], r["duration"]) for r in run_breaches(runs).collect()}
    assert got == {(1, "m2", 1501.0), (3, "m1", 121.0)}
