"""One local session for all tests; no credentials and no network."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tesserae.plans.runtime import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, spark__driver__memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(autouse=True)
def clean_environment(monkeypatch):
    for key in list(os.environ):
        if key.startswith("TESSERAE_"):
            monkeypatch.delenv(key)
