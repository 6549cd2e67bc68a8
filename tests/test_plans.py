"""Plan shape checks for the scale claims in README.md (final adaptive plans)."""

from __future__ import annotations

import re

from conftest import SF001
from logmold.operators.parse import parse_logs
from logmold.plans.catalog import QUERIES
from logmold.sources.lines import log_lines


def _final_plan(df) -> str:
    df.collect()  # runs the plan of this very DataFrame, so its final AQE plan is kept
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("== Initial Plan ==")[0]


def test_parse_scans_once_and_reuses_text_exchanges(spark):
    logs = parse_logs(log_lines(spark, SF001)).logs
    plan = _final_plan(logs)
    # the block table was checkpointed; the line branch scans the input once
    assert plan.count("FileScan parquet") == 1, plan
    # the batch exchange (all line text) feeds both the key branch and the batch rows
    assert re.search(r"ReusedExchange \[[^\]]*text[^\]]*\], Exchange hashpartitioning\(batch_id", plan), plan
    # the columns read are only those the log-line derivation needs
    scan = [line for line in plan.splitlines() if "FileScan parquet" in line][0]
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string,props:string>" in scan


def test_top_k_per_leaf_is_limited_before_the_shuffle(spark):
    for name in ("tree_instances", "tree_examples", "recent_examples"):
        df = QUERIES[name](spark, SF001)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("WindowGroupLimit") >= 2, name  # partial (map side) + final
