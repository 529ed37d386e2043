import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lumenloom.session import build_session

    base = tmp_path_factory.mktemp("spark")
    session = build_session("tests", cpus=4, **{"spark.sql.warehouse.dir": str(base / "warehouse"), "spark.checkpoint.dir": f"file://{base / 'shared'}"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
