import os
import sys

import duckdb
import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if REPO not in sys.path:
    sys.path.insert(0, REPO)

from quarry.session import local_session  # noqa: E402
from quarry.sources import TABLES  # noqa: E402

TESTDATA = "/root/testdata"
SF_SMOKE = f"{TESTDATA}/sf0.001"
SF_CHECK = f"{TESTDATA}/sf0.01"


@pytest.fixture(scope="session")
def event_log_dir(tmp_path_factory):
    return str(tmp_path_factory.mktemp("eventlog"))


@pytest.fixture(scope="session")
def spark(event_log_dir):
    session = local_session(cpus="*", shuffle_partitions=8, event_log_dir=event_log_dir)
    yield session
    session.stop()


def duck(sf_dir, overrides=None):
    """A DuckDB connection with every table of ``sf_dir`` as a view.

    ``overrides`` maps a table name to another parquet path (a derived copy).
    """
    con = duckdb.connect()
    overrides = overrides or {}
    for t in TABLES:
        path = overrides.get(t, f"{sf_dir}/{t}.parquet")
        if os.path.isdir(path):
            path = f"{path}/*.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows(df):
    return sorted(tuple(r) for r in df.collect())
