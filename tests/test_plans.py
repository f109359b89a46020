"""Physical plans: no products, no Python in expression operators, pruned scans."""

import pytest

from lifeline.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"
PURE = ["snapshot_diff", "scan_dedup", "one_per_pid", "parent_lookup", "kernel_times", "file_times", "exit_codes", "ps_ingest",
        "proc_text_ingest", "platform_defaults", "notice_normalise", "user_names", "sequence_gaps", "endpoint_gaps",
        "lost_counters", "batch_quality", "align_ids", "recent_hosts", "start_times", "process_ids"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PURE)
def test_expression_operators(spark, name):
    text = plan(QUERIES[name](spark, SF))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "MapInArrow", "BatchEvalPython"):
        assert node not in text, node


@pytest.mark.parametrize("name", ["replay_events", "reconcile_events", "source_fallback"])
def test_replay_has_no_product(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scans_are_pruned(spark):
    text = plan(QUERIES["sequence_gaps"](spark, SF))
    reads = {line.split("ReadSchema:")[1].strip() for line in text.splitlines() if "ReadSchema:" in line}
    assert reads and all("props" not in r and "value" not in r for r in reads)
    plain = plan(QUERIES["exit_codes"](spark, SF))
    assert "Exchange" not in plain


def test_group_limit_before_shuffle(spark):
    assert "WindowGroupLimit" in plan(QUERIES["recent_hosts"](spark, SF))
    assert "TakeOrderedAndProject" in plan(QUERIES["recent_summary"](spark, SF))
