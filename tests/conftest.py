import os
import sys
from collections.abc import Iterator

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])  # for Python workers

from tidemark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory: pytest.TempPathFactory) -> Iterator[SparkSession]:
    shared = tmp_path_factory.mktemp("spark")
    session = local_session(8, memory="6g", app="tests", **{"spark.checkpoint.dir": f"file://{shared}/checkpoints", "spark.sql.warehouse.dir": f"{shared}/warehouse", "spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()
