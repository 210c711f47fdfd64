import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from tickloom.session import local_session, ship_package  # noqa: E402

EVENT = (
    "asset_id string, market_id string, price double, best_bid double, best_ask double, "
    "recv_ts bigint, ord bigint"
)
BASE = 1_767_225_600_000  # 2026-01-01T00:00:00Z


@pytest.fixture(scope="session")
def spark():
    session = local_session(
        "4", spark__sql__shuffle__partitions="4",
        # small data: compiling the plans would take longer than running them
        spark__sql__codegen__wholeStage="false", spark__sql__codegen__factoryMode="NO_CODEGEN",
    )
    ship_package(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_events(spark):
    def make(points, asset="a1", market="m1"):
        """``(seconds, price)`` points as events of one asset."""
        rows = [
            (asset, market, float(price), 0.0, 0.0, BASE + round(s * 1000), i)
            for i, (s, price) in enumerate(points)
        ]
        return spark.createDataFrame(rows, EVENT)

    return make
