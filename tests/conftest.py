import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from quillspark.session import get_session

    return get_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "6g"})
