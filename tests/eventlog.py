"""Reading task metrics from Spark's event log (no web UI needed)."""

import glob
import json
import os
import time


def _lines(path):
    if path.endswith(".zstd"):
        import zstandard

        with open(path, "rb") as fh:
            yield from zstandard.ZstdDecompressor().stream_reader(fh).read().decode().splitlines()
    else:
        with open(path) as fh:
            yield from fh


def events(log_dir):
    files = [
        f
        for f in glob.glob(os.path.join(log_dir, "**", "*"), recursive=True)
        if os.path.isfile(f) and os.path.basename(f).startswith(("events_", "local-"))
    ]
    out = []
    for f in sorted(files):
        for line in _lines(f):
            line = line.strip()
            if line:
                try:
                    out.append(json.loads(line))
                except json.JSONDecodeError:
                    pass  # a partly written last line
    return out


def tasks_of_tagged_jobs(log_dir, key, value, timeout=60.0):
    """Task-end events of every job started with local property ``key=value``.

    Listener events reach the log asynchronously, after the action returned.
    Events are written in order: once the end of every SQL execution the
    tagged jobs belong to is in the log, all of their job starts are too, and
    once each of those jobs has ended, so have its tasks.
    """
    deadline = time.monotonic() + timeout
    while True:
        evs = events(log_dir)
        starts = [
            e
            for e in evs
            if e["Event"] == "SparkListenerJobStart"
            and (e.get("Properties") or {}).get(key) == value
        ]
        exec_ids = {(e.get("Properties") or {}).get("spark.sql.execution.id") for e in starts}
        exec_ids.discard(None)  # e.g. a file-listing job outside any SQL execution
        ended = {
            str(e.get("executionId"))
            for e in evs
            if e["Event"].endswith("SparkListenerSQLExecutionEnd")
        }
        jobs_ended = {e["Job ID"] for e in evs if e["Event"] == "SparkListenerJobEnd"}
        if starts and exec_ids <= ended and {e["Job ID"] for e in starts} <= jobs_ended:
            break
        if time.monotonic() > deadline:
            raise TimeoutError(
                f"tagged jobs {key}={value} not complete in the event log: "
                f"{len(starts)} job starts, executions {sorted(map(str, exec_ids))}, "
                f"ended {sorted(ended)[-5:]}, jobs ended {len(jobs_ended)}"
            )
        time.sleep(0.2)
    stages = {s for e in starts for s in e["Stage IDs"]}
    return [e for e in evs if e["Event"] == "SparkListenerTaskEnd" and e["Stage ID"] in stages]


def shuffle_records_read(task_end):
    return task_end["Task Metrics"]["Shuffle Read Metrics"]["Total Records Read"]
