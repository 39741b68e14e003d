import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from veilframe.plans.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    warehouse = str(tmp_path_factory.mktemp("warehouse"))
    session = local_session(
        "tests", 4, **{"spark.sql.warehouse.dir": warehouse, "spark.sql.shuffle.partitions": "4"}
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
