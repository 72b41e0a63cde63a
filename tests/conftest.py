import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    import gridmend

    root = tmp_path_factory.mktemp("spark")
    session = gridmend.session(
        "tests",
        "local[4]",
        **{"spark__sql__shuffle__partitions": "4", "spark__driver__memory": "3g", "spark__checkpoint__dir": f"file://{root}/shared", "spark__sql__warehouse__dir": f"file://{root}/warehouse"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
