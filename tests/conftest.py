from __future__ import annotations

import pytest

from cohortlens.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = str(tmp_path_factory.mktemp("shared"))
    session = local_session("tests", "4", **{"spark.checkpoint.dir": shared})
    yield session
    session.stop()
