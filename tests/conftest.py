"""One small session for all tests."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from granary.session import build_session

    shared = tmp_path_factory.mktemp("shared")
    session = build_session(
        "granary-tests", "local[4]", 4, **{"spark.driver.memory": "4g", "spark.ui.enabled": "false", "spark.checkpoint.dir": str(shared), "spark.sql.warehouse.dir": str(shared / "warehouse")}
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    connection = duckdb.connect()
    for path in sorted((DATA / "sf0.01").glob("*.parquet")):
        connection.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return connection
