import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from screenforge.session import ship_packages  # noqa: E402


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship_packages(spark, "screenforge")
