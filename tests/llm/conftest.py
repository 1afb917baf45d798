import os

import pytest


@pytest.fixture(scope="session")
def sf_dir():
    """The driver's smallest tables."""
    path = "/root/testdata/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("no test data")
    return path
