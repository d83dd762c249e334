import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from quillon.plans.session import session

    s = session("local[4]", 4, **{"spark.driver.memory": "4g", "spark.sql.warehouse.dir": "/tmp/quillon-warehouse"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    if not Path(DATA).exists():
        pytest.skip("no test tables here")
    return DATA
