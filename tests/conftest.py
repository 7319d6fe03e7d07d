import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from srcgraph.session import checkpoint_dir, get_spark
    s = get_spark("local[4]", 8)
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="srcgraph-test-ckpt-"))
    checkpoint_dir(s)
    yield s


def files_df(spark, files: dict[str, str], repo: str = "r"):
    rows = [(repo, p, c) for p, c in files.items()]
    return spark.createDataFrame(rows, "repo_id string, path string, content string")
