import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from verity.session import checkpoint_dir, local_session

    s = local_session(shuffle_partitions=8, checkpoint=str(tmp_path_factory.mktemp("shared")))
    checkpoint_dir(s)
    yield s
