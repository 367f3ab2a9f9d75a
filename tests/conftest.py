import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from kinfold.runtime import session

    s = session("kinfold-tests", 4, **{"spark.sql.shuffle.partitions": "4", "spark.sql.execution.arrow.maxRecordsPerBatch": "500"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
