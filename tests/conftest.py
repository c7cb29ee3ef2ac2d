import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from effectframe.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    folder = tempfile.mkdtemp(prefix="effectframe-tests-")
    session = local_session(
        8,
        2,
        **{
            "spark.checkpoint.dir": f"{folder}/checkpoint",
            "spark.sql.warehouse.dir": f"{folder}/warehouse",
        },
    )
    yield session
    session.stop()
