import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from barsmith.session import checkpoint_dir, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = local_session(4, shuffle_partitions=8, app="barsmith-tests")
    checkpoint_dir(s, str(tmp_path_factory.mktemp("checkpoints")))
    yield s
