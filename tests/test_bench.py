import json
import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_bench_prints_one_json_line():
    env = dict(os.environ, BENCH_SF_DIR="/root/testdata/sf0.001", BENCH_CPUS="2", BENCH_REPS="1")
    out = subprocess.run(
        [sys.executable, os.path.join(ROOT, "bench.py"), "silver_customer_summary"],
        env=env, capture_output=True, text=True, timeout=600, cwd=ROOT,
    )
    lines = [l for l in out.stdout.splitlines() if l.startswith("{")]
    assert len(lines) == 1, out.stderr[-2000:]
    rec = json.loads(lines[0])
    assert rec["unit"] == "sec" and rec["sf"] == "0.001"
    assert set(rec["queries"]) == {"silver_customer_summary"} and rec["value"] > 0
