from __future__ import annotations

import pytest

from brindle.session import forget, local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    yield session
    forget()
    session.stop()
