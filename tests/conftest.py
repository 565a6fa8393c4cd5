import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from paysheaf import session  # noqa: E402
from paysheaf.plans import reuse  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session.build(
        "local[4]", "paysheaf-tests", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g"}
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(autouse=True)
def _release():
    with reuse.scope() as kept:
        yield
    kept.close()
