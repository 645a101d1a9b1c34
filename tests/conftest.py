import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from emporia.session import build_session

    s = build_session("local[4]", 4, app_name="emporia-tests",
                      extra={"spark.sql.execution.arrow.maxRecordsPerBatch": "64"})
    if not s.conf.get("spark.checkpoint.dir", None) and not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="emporia-test-ckpt-"))
    yield s
    s.stop()
