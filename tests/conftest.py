from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from panelwise.session import local_session

    session = local_session("8", partitions=4)
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Collect a DataFrame as a list of dicts, sorted by the given columns."""

    def collect(df, *order):
        return [r.asDict() for r in (df.orderBy(*order) if order else df).collect()]

    return collect
