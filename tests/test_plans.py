"""Plan shape: native expressions only, no cross joins, partitioned windows, pushdown, pruning."""
import re

import pytest

from conftest import SF
from tillroll.operators import baskets, demand
from tillroll.plans.registry import QUERIES
from tillroll.sources import tables as tb

PYTHON_NODES = ["BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas",
                "PythonUDF"]
PAIR_JOINS = ["CartesianProduct", "BroadcastNestedLoopJoin"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_and_no_unpartitioned_window(spark, name):
    p = plan(QUERIES[name](spark, SF))
    for node in PYTHON_NODES + PAIR_JOINS:
        assert node not in p, f"{name}: {node}"
    for line in p.splitlines():
        if re.search(r"\bWindow \[", line):
            assert not re.search(r"\], \[\], \[", line), f"{name}: unpartitioned window"


def test_branch_filter_reaches_the_scan(spark):
    t = tb.Tables(spark, SF)
    p = plan(demand.demand_forecast(tb.monthly_sales(t), 3, branch="BUILDING"))
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(c_mktsegment,BUILDING\)", p)


def test_basket_scan_reads_only_needed_columns(spark):
    t = tb.Tables(spark, SF)
    p = plan(baskets.build_baskets(tb.delivery_lines(t)))
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", p)
    li = [s for s in schemas if "l_orderkey" in s][0]
    assert "l_shipdate" not in li and "l_tax" not in li and "l_comment" not in li
    assert "l_quantity" in li and "l_extendedprice" in li


def test_published_reports_join_line_items_once(spark):
    """Reports that run together read one table of classified line items, and hold the rows of their own queries."""
    from conftest import SF, rows
    from tillroll.plans import registry as R
    shared = R.SharedTables(spark, SF)
    for name in ("segment_share", "segment_comparison", "segment_performance", "growth_actions"):
        df = R.PLANS[name](shared)
        assert "lineitem" not in df._jdf.queryExecution().optimizedPlan().toString()
        assert rows(df) == rows(R.QUERIES[name](spark, SF), *df.columns)
