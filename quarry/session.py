"""SparkSession settings for local runs (tests, bench).

On a cluster the session comes from the deployment; the library does not
change session settings behind the caller's back.  The settings here are the
ones the plans are designed around, so local runs exercise the same plan
shapes a cluster would:

* adaptive execution on (runtime re-planning, partition coalescing);
* no broadcast from static size *estimates* (a file-size estimate is not a
  bound: Parquet is compressed and filters are guessed); adaptive execution
  still turns a join into a broadcast when the *measured* shuffle output of a
  side is under ``spark.sql.adaptive.autoBroadcastJoinThreshold``;
* session time zone UTC, no web UI.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Fixed value: largest measured join side adaptive execution may broadcast.
RUNTIME_BROADCAST_LIMIT = "10MB"


def local_session(
    cpus: int | str = "*",
    shuffle_partitions: int = 8,
    app_name: str = "quarry",
    driver_memory: str = "8g",
    event_log_dir: str | None = None,
) -> SparkSession:
    """A ``local[cpus]`` session with the settings above.

    ``event_log_dir`` (or ``QUARRY_EVENT_LOG_DIR``) turns on Spark's event
    log, for stage and task times without the web UI.
    """
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.autoBroadcastJoinThreshold", "-1")
        .config("spark.sql.adaptive.autoBroadcastJoinThreshold", RUNTIME_BROADCAST_LIMIT)
    )
    log_dir = event_log_dir or os.environ.get("QUARRY_EVENT_LOG_DIR")
    if log_dir:
        if "://" not in log_dir:
            os.makedirs(log_dir, exist_ok=True)
        builder = (
            builder.config("spark.eventLog.enabled", "true")
            .config("spark.eventLog.dir", log_dir)
            # Plain JSON lines, readable without a codec.
            .config("spark.eventLog.compress", "false")
        )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
