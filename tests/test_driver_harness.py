"""What the driver runs, run the way the driver runs it: fresh processes."""

import json
import os
import subprocess
import sys
import textwrap

import __spark_entry__ as contract
from quarry.sources import TABLES
from tests.conftest import REPO, SF_CHECK, SF_SMOKE


def test_bench_prints_one_json_line(tmp_path):
    env = {**os.environ, "BENCH_SF_DIR": SF_SMOKE, "BENCH_CPUS": "2", "BENCH_RUNS": "1"}
    env["BENCH_QUERIES"] = ",".join(contract.core_queries())
    proc = subprocess.run(
        [sys.executable, os.path.join(REPO, "bench.py")],
        capture_output=True,
        text=True,
        timeout=600,
        env=env,
        cwd=tmp_path,
    )
    assert proc.returncode == 0, proc.stderr[-3000:]
    lines = [line for line in proc.stdout.splitlines() if line.strip()]
    assert len(lines) == 1
    out = json.loads(lines[0])
    assert {"metric", "value", "unit", "queries", "sf"} <= set(out)
    assert out["unit"] == "sec" and out["sf"] == 0.001
    assert set(out["queries"]) == set(contract.core_queries())
    assert out["value"] > 0


def test_entry_module_from_another_directory(tmp_path):
    script = tmp_path / "driver.py"
    script.write_text(
        textwrap.dedent(
            f"""
            import importlib.util, json
            import duckdb
            from pyspark.sql import SparkSession

            spec = importlib.util.spec_from_file_location(
                "entry_under_test", {os.path.join(REPO, "__spark_entry__.py")!r}
            )
            mod = importlib.util.module_from_spec(spec)
            spec.loader.exec_module(mod)

            # Spark's defaults, as a driver would have them.
            spark = (
                SparkSession.builder.master("local[2]")
                .config("spark.ui.enabled", "false")
                .config("spark.driver.bindAddress", "127.0.0.1")
                .config("spark.driver.host", "127.0.0.1")
                .getOrCreate()
            )
            n_entry = mod.entry(spark).count()
            con = duckdb.connect()
            for t in {list(TABLES)!r}:
                con.execute(
                    f"CREATE VIEW {{t}} AS SELECT * FROM read_parquet('{SF_CHECK}/{{t}}.parquet')"
                )
            same = {{}}
            for name, q in mod.core_queries().items():
                got = sorted(tuple(r) for r in q(spark, {SF_CHECK!r}).collect())
                same[name] = got == sorted(con.execute(mod.oracle_sql()[name]).fetchall())
            print(json.dumps({{"entry_rows": n_entry, "same": same}}))
            """
        )
    )
    proc = subprocess.run(
        [sys.executable, str(script)], capture_output=True, text=True, timeout=600, cwd=tmp_path
    )
    assert proc.returncode == 0, proc.stderr[-3000:]
    out = json.loads(proc.stdout.strip().splitlines()[-1])
    assert out["entry_rows"] > 0
    assert out["same"] and all(out["same"].values())
