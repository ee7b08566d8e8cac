"""Physical plans: what reaches the scan, and what must not appear."""

import pytest

from latticeq import session
from latticeq.plans import registry

from .helpers import SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(registry.QUERIES["filter_min_side"](spark, SMALL))
    assert "GreaterThanOrEqual(n_chars,96)" in text and "ReadSchema: struct<doc_id:bigint,source:string,n_chars:bigint>" in text
    assert "ReadSchema: struct<doc_id:bigint,text:string,source:string>" in plan(registry.QUERIES["dedupe_exact"](spark, SMALL))
    assert "text" not in plan(registry.QUERIES["source_split_pivot"](spark, SMALL)).split("ReadSchema")[1]


@pytest.mark.parametrize("name", ["identify_topk", "cosine_matrix_topk", "p1_rollup", "near_dup_edges", "supcon_loss", "kmeans_step", "verify_pairs", "dedupe_exact"])
def test_no_cartesian_product_and_no_python(spark, name):
    text = plan(registry.QUERIES[name](spark, SMALL))
    assert "CartesianProduct" not in text and "Python" not in text and "Pandas" not in text


def test_top_k_is_cut_before_the_exchange(spark):
    assert "WindowGroupLimit" in plan(registry.QUERIES["cosine_matrix_topk"](spark, SMALL))


def test_session_settings():
    assert session.shuffle_partitions(100 << 40, 4000) == (100 << 40) // (128 << 20)
    assert session.shuffle_partitions(0, 8) == 24
