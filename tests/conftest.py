import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from loomkb.session import local_session

    from loomkb.storage import remove_scratch

    session = local_session(4, 4, memory="4g", app="tests")
    yield session
    remove_scratch(session)
    session.stop()
