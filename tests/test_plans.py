"""Plans keep what makes the jobs scale."""

import pytest

from checks.registry import QUERIES
from hemline.operators import runs, scale

import __spark_entry__  # noqa: E402, F401 - registers the queries

SF = "/root/testdata/sf0.001"
PYTHON_JOBS = (
    "listing_search", "ext_01", "ext_02", "ext_03", "ext_04", "set_03", "set_04", "sam_05", "sam_06", "sam_07",
)
WRITES_FIRST = (
    "str_", "src_01", "src_02", "src_04", "src_05", "src_06", "src_09", "src_10", "src_11", "src_12", "src_13",
    "win_09_failure_runs_split",
)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    return {n: plan(fn(spark, SF)) for n, fn in QUERIES.items() if not n.startswith(WRITES_FIRST)}


def test_no_cross_joins(plans):
    for name, p in plans.items():
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


def test_python_only_where_pages_and_pixels_need_it(plans):
    for name, p in plans.items():
        uses = any(k in p for k in ("ArrowEvalPython", "MapInPandas", "BatchEvalPython"))
        assert uses == name.startswith(PYTHON_JOBS), name
        assert "BatchEvalPython" not in p, name


def test_scans_read_only_needed_columns(plans):
    assert "ReadSchema: struct<lang:string>" in plans["agg_02_balance_gaps"]
    assert "ReadSchema: struct<page_id:bigint,url:string>" not in plans["src_08_read_pages"]
    assert "html" not in plans["geo_01_haversine_km"]


def test_filters_reach_the_scan(plans):
    assert "EqualTo(o_custkey,7)" in plans["join_05_visible_messages"]
    assert "EqualTo(conv_id,3)" in plans["ord_02_messages"]
    assert "GreaterThan(o_totalprice,250000.0)" in plans["join_06_delete_cascade"]


def test_top_n_is_cut_before_the_shuffle(plans):
    for name in ("win_01_top_n", "win_02_first_n_per_category", "win_03_context_window", "join_03_pending_items"):
        assert "WindowGroupLimit" in plans[name], name
    assert "TakeOrderedAndProject" in plans["ord_01_recent_chats"]


def test_small_tables_are_broadcast(plans):
    for name in ("agg_09_coverage_score", "agg_11_constraint_score", "join_10_lookup", "src_14_city_dim"):
        assert "BroadcastHashJoin" in plans[name], name


def test_many_first_rows_never_sort_a_whole_category(spark):
    items = spark.range(4000).selectExpr("concat('c', id % 2) AS category", "lpad(id, 6, '0') AS filename")
    few = plan(scale.first_n(items, ["category"], ["filename"], 1000))
    assert "WindowGroupLimit" in few
    many = scale.first_n(items, ["category"], ["filename"], 1500, hot_rows=100)
    assert "_slab" in plan(many) and "WindowGroupLimit" not in plan(many)
    assert sorted(r["rank"] for r in many.collect()) == sorted([*range(1, 1501)] * 2)
    plain = scale.first_n(items, ["category"], ["filename"], 1500, split=False)
    assert {tuple(r) for r in plain.collect()} == {tuple(r) for r in many.collect()}


def test_no_job_while_building_when_the_split_is_known(spark):
    calls = spark.range(100).selectExpr("id % 3 AS key_id", "timestamp_seconds(id) AS ts", "id AS event_id", "id % 2 = 0 AS ok")
    before = _jobs(spark)
    runs.failure_runs(calls, ["ts", "event_id"], 3, 12, split=False)
    scale.ranked(calls, ["key_id"], ["ts"], "n", split=False)
    assert _jobs(spark) == before


def test_running_means_agree_exactly_however_rows_are_divided(spark):
    steps = spark.range(500).selectExpr("id % 2 AS run", "id AS step", "pow(1.37, id % 91) / 3 AS loss")
    one = runs.running_mean_loss(steps, ["step"], split=False).collect()
    many = runs.running_mean_loss(steps, ["step"], split=True).collect()
    assert sorted((r["run"], r["step"], r["avg_loss"]) for r in one) == sorted((r["run"], r["step"], r["avg_loss"]) for r in many)


def _jobs(spark) -> int:
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
