import json
import os

import pytest

from strata.operators.gates import failure_phases, run_verdict
from strata.sources.metrics import cycles_of_metrics, latest_cycles, notes, read_cycles, read_metrics


def _write(path, document, at):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        json.dump(document, f, indent=2)
    os.utime(path, (at, at))


def _cycle(n, outcome="pass", phase=None, reset=10, e2e=100):
    row = {"cycle": n, "hard_mode": 0, "reset_duration": reset, "health_check_duration": 5, "total_e2e_duration": e2e}
    if phase not in ("reset", "seed"):
        row |= {"seed_duration": 20, "demo_duration": 50}
    if outcome == "pass":
        row["verify_duration"] = 3
    row["outcome"] = outcome
    return row | ({"failure_phase": phase} if phase else {})


def _landed(spark, workdir):
    one = {"dry_run_date": "2026-01-01T00:00:00Z", "total_cycles": 3, "hard_mode_cycle": 2, "summary": {"m1": {"min": 1}}}
    early = one | {"cycles": [_cycle(1)], "notes": []}
    late = one | {"cycles": [_cycle(1, e2e=110), _cycle(2, "fail", "seed")], "notes": ["Cycle 2: seed failed"]}
    _write(f"{workdir}/backup/dry-run-1/metrics.json", early, 1_700_000_000)
    _write(f"{workdir}/now/dry-run-1/metrics.json", late, 1_700_000_100)
    _write(f"{workdir}/now/dry-run-1/cycle-3.json", _cycle(3), 1_700_000_200)
    _write(f"{workdir}/now/dry-run-2/metrics.json", one | {"cycles": [], "notes": None}, 1_700_000_100)
    documents = read_metrics(spark, workdir, glob="metrics.json")
    return documents, latest_cycles(cycles_of_metrics(documents), read_cycles(spark, workdir))


def test_latest_file_of_each_cycle_counts_and_absent_keys_are_null(spark, workdir):
    _, runs = _landed(spark, workdir)
    got = {(r["run"], r["cycle"]): r for r in runs.collect()}
    assert got.keys() == {("dry-run-1", 1), ("dry-run-1", 2), ("dry-run-1", 3)}
    assert got["dry-run-1", 1]["total_e2e_duration"] == 110
    failed = got["dry-run-1", 2]
    assert failed["failure_phase"] == "seed" and failed["seed_duration"] is None and failed["verify_duration"] is None
    assert got["dry-run-1", 3]["failure_phase"] is None


def test_verdict_phases_and_notes_from_files(spark, workdir):
    documents, runs = _landed(spark, workdir)
    verdict = run_verdict(runs, ["run"]).first()
    assert (verdict["cycles"], verdict["flakes"], verdict["verdict"]) == (3, 1, "NOT READY")
    assert [tuple(r) for r in failure_phases(runs, ["run"]).collect()] == [("dry-run-1", "seed", 1, 2, 100)]
    assert [(r["run"], r["note"]) for r in notes(documents).collect()] == [("dry-run-1", "Cycle 2: seed failed")]


def test_a_document_that_does_not_parse_fails_the_read(spark, workdir):
    os.makedirs(f"{workdir}/dry-run-1")
    with open(f"{workdir}/dry-run-1/metrics.json", "w") as f:
        f.write('{"cycles": [')
    with pytest.raises(Exception, match="(?i)malformed|parse|FAILFAST"):
        read_metrics(spark, workdir).collect()
