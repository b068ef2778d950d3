"""A task that dies mid-query is retried, and the result is bit-identical.

Runs in its own process: the session needs ``local[N,maxFailures]`` so Spark
retries failed tasks, which the shared test session does not.  The failure
is injected by a test-only Python filter on the line items that raises on
the first attempt of one scan task.
"""

import json
import os
import subprocess
import sys
import textwrap

from tests.conftest import REPO, SF_CHECK

SCRIPT = textwrap.dedent(
    """
    import json, sys
    sys.path.insert(0, REPO)
    from pyspark import TaskContext
    from pyspark.sql import SparkSession, functions as F
    from quarry.plans import revenue_by_priority
    from quarry.sources import read_table

    spark = (
        SparkSession.builder.master("local[4,4]")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.autoBroadcastJoinThreshold", "-1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")

    @F.udf("boolean")
    def dies_once(k):
        ctx = TaskContext.get()
        if ctx.attemptNumber() == 0 and ctx.partitionId() == 0:
            raise RuntimeError("injected task failure")
        return True

    cols = ["l_orderkey", "l_extendedprice", "l_discount", "l_shipdate"]
    orders = read_table(spark, SF, "orders", ["o_orderkey", "o_orderpriority"])

    def run(lineitem):
        return sorted(tuple(r) for r in revenue_by_priority(lineitem, orders).collect())

    # Several scan tasks, so one can fail while others finish.
    lineitem = read_table(spark, SF, "lineitem", cols).repartition(4)
    clean = run(lineitem)
    sc = spark.sparkContext
    sc.setJobGroup("flaky", "query with an injected task failure")
    flaky = run(lineitem.where(dies_once("l_orderkey")))
    tracker = sc.statusTracker()
    failed = sum(
        tracker.getStageInfo(stage).numFailedTasks
        for job in tracker.getJobIdsForGroup("flaky")
        for stage in tracker.getJobInfo(job).stageIds
        if tracker.getStageInfo(stage) is not None
    )
    print(json.dumps({"clean": clean, "flaky": flaky, "failed_tasks": failed}))
    """
)


def test_retried_task_gives_identical_result(tmp_path):
    script = tmp_path / "flaky.py"
    script.write_text(f"REPO = {REPO!r}\nSF = {SF_CHECK!r}\n" + SCRIPT)
    proc = subprocess.run(
        [sys.executable, str(script)],
        capture_output=True,
        text=True,
        timeout=300,
        env={**os.environ, "PYTHONPATH": REPO},
    )
    assert proc.returncode == 0, proc.stderr[-3000:]
    out = json.loads(proc.stdout.strip().splitlines()[-1])
    assert out["clean"] == out["flaky"]
    assert len(out["clean"]) == 5
    assert out["failed_tasks"] >= 1
