import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session", autouse=True)
def sent(spark):
    """The package reaches the Python workers as it does in the queries."""
    from thermalcube.llm.common import ready

    return ready(spark)
