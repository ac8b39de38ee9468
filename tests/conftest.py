import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from carecheck.session import get_spark
    s = get_spark("local[4]", app="carecheck-tests", shuffle_partitions=4,
                  spark__checkpoint__dir=tempfile.mkdtemp(prefix="carecheck-test-ckpt-"))
    yield s
    s.stop()
