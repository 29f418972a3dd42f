"""Every registered query against its SQL twin, and the shape of the plans."""

import re

import pytest
from compare import connect, differences
from conftest import SF

from registry.all import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck():
    con = connect(SF)
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows_as_sql(spark, duck, name):
    assert name in ORACLES
    assert differences(QUERIES[name](spark, SF), duck, ORACLES[name]) == []


def plan_of(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


# Queries that run jobs while being built are looked at by the results above only.
LAZY = sorted(n for n in QUERIES if not re.match(r"(io|c\d|a12)", n))


@pytest.mark.parametrize("name", LAZY)
def test_plan_has_no_cross_join_and_no_python(spark, name):
    plan = plan_of(spark, name)
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas", "FlatMapGroups"):
        assert bad not in plan, bad
    # Only totals over the whole table, already reduced in every task, may end in one partition.
    lines = plan.splitlines()
    for line, below in zip(lines, lines[1:], strict=False):
        if "Exchange SinglePartition" in line:
            assert "HashAggregate(keys=[], functions=[partial_" in below


@pytest.mark.parametrize(
    ("name", "scans"),
    [("s1_condense_spells", 1), ("s3_invert_spells", 1), ("s7_snapshots_to_spells", 1), ("g1_group_members", 1),
     ("g2_distribution_by_flags", 1), ("g8_mean_sweep", 1), ("g9_pair_counts", 1), ("v_tidy_wide_table", 1)],
)
def test_input_is_read_once(spark, name, scans):
    assert plan_of(spark, name).count("FileScan") == scans


def test_condensing_orders_days_not_rows(spark):
    """The window of a key comes after rows were reduced to days with map-side combine."""
    plan = plan_of(spark, "s1_condense_spells")
    assert plan.count("Exchange hashpartitioning") == 2
    assert plan.index("Window") < plan.rindex("partial_max")


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns[-2:] == ["total", "days"]
    assert entry.entry(spark).count() > 0
