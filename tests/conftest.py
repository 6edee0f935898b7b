from __future__ import annotations

import os
import sys
from contextlib import contextmanager

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from checks.compare import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def settings(spark):
    """Change session settings for one block."""

    @contextmanager
    def changed(**values):
        names = {key.replace("__", "."): value for key, value in values.items()}
        before = {key: spark.conf.get(key, None) for key in names}
        for key, value in names.items():
            spark.conf.set(key, value)
        try:
            yield
        finally:
            for key, value in before.items():
                spark.conf.unset(key) if value is None else spark.conf.set(key, value)

    return changed


@pytest.fixture
def many_slices(settings):
    """Range partitions stay apart, however small they are."""
    with settings(spark__sql__adaptive__coalescePartitions__enabled="false"):
        yield
