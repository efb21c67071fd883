import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from curbwatch.session import local_session  # noqa: E402

from .fixtures import edge_detections  # noqa: E402

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    checkpoints = str(tmp_path_factory.mktemp("checkpoints"))
    session = local_session(8, shuffle_partitions=8, app="curbwatch-tests", checkpoint_dir=checkpoints)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def edge(spark):
    return edge_detections(spark).cache()


@pytest.fixture(scope="session")
def f2(spark):
    from curbwatch.sources import load_detections

    return load_detections(spark, SF001)
