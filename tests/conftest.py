import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from strataframe.session import local_session, ship

    session = local_session(4, "3g")
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    return session
