"""Driver contract of bench.py: one JSON line with the required keys."""

import json
import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_bench_prints_one_json_line():
    env = {**os.environ, "BENCH_SF_DIR": "/root/testdata/sf0.001", "BENCH_CPUS": "4", "BENCH_REPEAT": "1"}
    out = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py")], env=env, capture_output=True,
                         text=True, timeout=900, check=True).stdout
    lines = [ln for ln in out.splitlines() if ln.strip()]
    assert len(lines) == 1
    b = json.loads(lines[0])
    assert {"metric", "value", "unit", "queries", "sf"} <= set(b)
    assert b["unit"] == "sec" and b["sf"] == "0.001" and b["value"] > 0
    import __spark_entry__ as E

    assert set(b["queries"]) == set(E.queries())
