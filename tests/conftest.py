import os
import shutil
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from snaplytics.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    warehouse = tmp_path_factory.mktemp("warehouse")
    session = local_session(
        "tests", "8", partitions=4, **{"spark.sql.warehouse.dir": str(warehouse), "spark.driver.memory": "6g"}
    )
    yield session
    session.stop()
    shutil.rmtree(warehouse)  # with the checkpoint folder in it
