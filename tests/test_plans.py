"""Plans are the ones wanted: columns pruned, filters pushed, no pairing of whole tables."""

import pytest

from quern.plans import catalog

QUERIES = catalog.queries()
BLOCKED = {"vector_topk_cosine", "vector_topk_dot", "rrf_fusion"}  # blocks of queries meet blocks of rows
ACTS = {"derivation_closure", "refine_pipeline", "stream_windows", "stream_sessions", "train_val_split", "ratio_mix"} | BLOCKED


def plan(spark, sf, name):
    return QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - ACTS))
def test_no_cartesian_product(spark, sf, name):
    assert "CartesianProduct" not in plan(spark, sf, name)


@pytest.mark.parametrize(
    "name,columns",
    [("latency_stats", "struct<category:string,latency:double>"), ("event_latency", "struct<event_type:string,value:double>"), ("graph_neighbors", "struct<l_orderkey:bigint,l_partkey:bigint>"), ("garbage_ratio", "struct<pdf_name:string,text:string>")],
)
def test_only_needed_columns_are_read(spark, sf, name, columns):
    assert f"ReadSchema: {columns}" in plan(spark, sf, name)


@pytest.mark.parametrize("name,pushed", [("latency_stats", "IsNotNull(latency)"), ("sampled_pages", "In(number, [100,15,150,200,50])"), ("sentence_split", "IsNotNull(output)")])
def test_filters_reach_the_scan(spark, sf, name, pushed):
    assert pushed in plan(spark, sf, name)


def test_top_k_is_cut_before_the_shuffle(spark, sf):
    assert "WindowGroupLimit" in plan(spark, sf, "bm25_topk")
