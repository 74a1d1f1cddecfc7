import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from parcelflow.session import build_session

    session = build_session("tests", cores=4, partitions=4, **{"spark.sql.autoBroadcastJoinThreshold": "1m"})
    yield session
    session.stop()
