"""Queries that must not walk all pairs of large groups of rows."""

import re
import time

import pytest

import __spark_entry__ as entry
from kinlink.operators import blocking
from kinlink.plans import blocking_queries, text_queries
from kinlink.plans.views import view

KINDS = "CASE id % 3 WHEN 0 THEN 'red ring' WHEN 1 THEN 'red bolt' ELSE 'old gear' END"


def test_name_pairs_are_those_of_all_parts(spark, tmp_path):
    rows = [(1, "a", "x", "t"), (2, "b", "x", "t"), (3, "a", "x", "t"), (4, "c", "y", "t"), (5, "a", "y", "t"), (6, None, "y", "t"), (7, "d", None, "t"), (8, "e", None, "t"), (None, "f", "x", "t")]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(str(tmp_path / "part.parquet"))
    pairs = lambda df: sorted(map(tuple, df.collect()), key=str)
    found = pairs(text_queries._distinct_name_pairs(spark, str(tmp_path)))
    assert found == pairs(text_queries._name_pairs(spark, str(tmp_path))) and ("a", "a") in found and ("b", "a") in found and ("c", "c") not in found


@pytest.mark.parametrize("name,n", [("sim06_best_match", 3), ("sim01_ratios", 9), ("sim05_jaro_winkler", 9), ("sim04_partial_ratio", 9)])
def test_a_large_group_of_parts(spark, tmp_path, name, n):
    """60,000 parts of one type and brand, 1.8 billion pairs, but three names."""
    spark.range(60_000).selectExpr("id AS p_partkey", f"{KINDS} AS p_name", "'t' AS p_type", "'b' AS p_brand").write.parquet(str(tmp_path / "part.parquet"))
    began = time.monotonic()
    assert len(entry.queries()[name](spark, str(tmp_path)).collect()) == n
    assert time.monotonic() - began < 30


def test_best_configuration_walks_no_lists_of_candidates(spark):
    plan = entry.queries()["rp05_best_configuration"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "MapInArrow" in plan


def test_lost_recall_of_groups_is_that_of_their_pairs(spark, tmp_path):
    """Records of few names, many of them alike: the query joins no true pairs one by one, and counts what listing them counts."""
    spark.range(900).selectExpr("id AS p_partkey", f"{KINDS.replace("id % 3", "id % 5")} AS p_name", "concat('T', id % 2) AS p_type", "concat('Brand#', id % 4) AS p_brand", "cast(id % 12 AS int) AS p_size").write.parquet(str(tmp_path / "part.parquet"))
    sf = str(tmp_path)
    keys = blocking.keys(blocking_queries.records(spark, sf))
    listed = blocking.lost_recall(keys, blocking.blocks(keys), view(spark, sf, "truth"), 2000).first()
    asked = []
    original = blocking_queries.view
    blocking_queries.view = lambda s, d, name: (asked.append(name), original(s, d, name))[1]
    try:
        assert entry.queries()["bk17_lost_recall"](spark, sf).first() == listed and "truth" not in asked
    finally:
        blocking_queries.view = original
    assert listed.n_true > 1000


def test_features_broadcast_no_table_of_records(spark):
    """Files of repeated values are small, so Spark would take tables of all records for small ones and collect them in the driver."""
    plan = entry.queries()["fe00_all_features"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.split("\n") if "BroadcastHashJoin" in line]
    assert "SortMergeJoin" in plan and not [x for x in joins if re.search(r"\b(idx|s1|h)#\d+", x.split("]")[0]) or "tok#" in x and "BuildLeft" in x]
