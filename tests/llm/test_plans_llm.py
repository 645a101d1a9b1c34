"""Plan shape of the training-data queries: no join without a key."""
import contextlib
import io

import pytest

from emporia.llm.registry import QUERIES

SF001 = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_joins(spark, name):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        QUERIES[name](spark, SF001).explain(mode="formatted")
    assert "CartesianProduct" not in buf.getvalue()
    assert "BroadcastNestedLoopJoin" not in buf.getvalue()
