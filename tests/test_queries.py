"""Every query against its SQL at the smallest scale, and the shape of some plans."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tools.compare import compare, connect  # noqa: E402
from workload import ORACLES, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, SF, name)[0] in ("ok", "no sql")


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)


def plan_of(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_cross_join_and_no_global_window(spark, name):
    plan = plan_of(spark, name)
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "SinglePartition" not in plan


@pytest.mark.parametrize("name", [
    "path_facts", "language_detect", "ignore_verdict", "ignore_verdict_v2", "text_check_v1", "line_diff",
    "render_diff", "apply_edits", "parse_edits", "parse_edits_intended", "apply_edits_multi", "working_set", "applicable_rules", "glob_match",
])
def test_per_file_queries_do_not_shuffle(spark, name):
    assert "Exchange" not in plan_of(spark, name)
