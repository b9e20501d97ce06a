import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lociflow.session import get_session

    base = tmp_path_factory.mktemp("spark")
    s = get_session("tests", 8, **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g", "spark.sql.warehouse.dir": str(base / "wh"), "spark.checkpoint.dir": str(base / "cp")})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
