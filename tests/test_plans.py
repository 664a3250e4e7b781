"""Plan shape of every registered query: no Python evaluation in the data
path, no cartesian product, and scans that read only referenced columns."""

import contextlib
import io
import re

import pytest

from basketlens.plans.catalog import QUERIES
from conftest import SF_SMALL


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_shape(spark, name):
    plan = _plan(QUERIES[name](spark, SF_SMALL))
    for node in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas",
                 "MapInPandas", "CartesianProduct"):
        assert node not in plan, f"{name}: {node}"
    # nested-loop joins only ever have a broadcast one-row side (global aggregates)
    if "BroadcastNestedLoopJoin" in plan:
        assert "BroadcastExchange" in plan
    # no scan reads every column of the wide order master
    for schema in re.findall(r"ReadSchema: struct<(.*)>", plan):
        assert schema.count(":") < 25, f"{name}: reads {schema.count(':')} columns"
