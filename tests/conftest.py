from __future__ import annotations

import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from ledgerlens.session import local_session  # noqa: E402

LEDGER_SCHEMA = (
    "txn_id bigint, customer_id bigint, txn_ts timestamp_ntz, txn_type string, channel string, "
    "amount double, status string, international string, risk_flag string"
)
ACCOUNT_SCHEMA = "customer_id bigint, segment string, account_status string, preferred_channel string"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, app="tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def ledger_of(spark):
    """Build a ledger from dicts; columns left out take an unremarkable value."""

    def build(*rows: dict):
        base = dt.datetime(2026, 1, 15, 12, 0)
        full = []
        for i, row in enumerate(rows, start=1):
            defaults = {
                "txn_id": i,
                "customer_id": 1,
                "txn_ts": base + dt.timedelta(hours=i),
                "txn_type": "Transfer",
                "channel": "Mobile App",
                "amount": 100.0,
                "status": "Successful",
                "international": "No",
                "risk_flag": "No",
            }
            full.append(tuple({**defaults, **row}.values()))
        return spark.createDataFrame(full, LEDGER_SCHEMA)

    return build


@pytest.fixture(scope="session")
def accounts_of(spark):
    def build(*rows: tuple):
        return spark.createDataFrame(list(rows), ACCOUNT_SCHEMA)

    return build
