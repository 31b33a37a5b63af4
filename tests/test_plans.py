"""Plan-shape guards: the physical plans keep the properties the scale
design relies on (see PLANS.md)."""

import re

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from sigeval.plans.queries import QUERIES

PYTHON_NODES = r"MapInPandas|ArrowEvalPython|BatchEvalPython|FlatMapGroupsInPandas"


def plan_of(spark, key):
    return E.queries()[key](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()


def shuffles(plan):
    return len(re.findall(r"Exchange (?:hashpartitioning|rangepartitioning|SinglePartition)", plan))


def test_encode_reads_only_what_it_needs_and_counts_before_the_shuffle(spark):
    plan = plan_of(spark, "encode_sequences")
    scans = re.findall(r"FileScan parquet \[([^\]]*)\]", plan)
    used = {c.strip().split("#")[0] for s in scans for c in s.split(",")}
    assert len(scans) == 2 and used == {"event_id", "event_type", "ts", "user_id"}
    assert "partial_count" in plan


@pytest.mark.parametrize("key", ["encode_sequences", "metadata_rows", "shuffle", "train_val_split", "balanced_dataset"])
def test_numbering_is_lazy(spark, key):
    """Read straight from the table: nothing was collected or checkpointed."""
    assert "ExistingRDD" not in plan_of(spark, key)


@pytest.mark.parametrize("key", sorted(set(QUERIES) - {"complete_batch", "label_search"}))
def test_no_python_outside_completion_and_label_search(spark, key):
    assert not re.search(PYTHON_NODES, plan_of(spark, key))


def test_completion_is_map_in_pandas(spark):
    assert "MapInPandas" in plan_of(spark, "complete_batch")


def test_range_join_broadcasts_only_the_range_table(spark):
    plan = plan_of(spark, "label_by_range")
    assert "BroadcastNestedLoopJoin" in plan
    builds = [b.split("\n+-")[0] for b in plan.split("BroadcastExchange")[1:] if "IdentityBroadcastMode" in b.split("\n")[0]]
    assert len(builds) == 1 and "regime" in builds[0]


def test_per_class_sample_limits_before_shuffle(spark):
    plan = plan_of(spark, "sample_balanced")
    assert re.search(r"WindowGroupLimit .*Partial", plan)


def test_metrics_are_one_pass(spark):
    """No join but the one that numbers the events."""
    joins = len(re.findall(r"\w+Join ", plan_of(spark, "encode_sequences")))
    for key in ("metrics_long", "metrics_fixed", "class_distribution"):
        plan = plan_of(spark, key)
        assert len(re.findall(r"\w+Join ", plan)) == joins and "Subquery" not in plan, key
