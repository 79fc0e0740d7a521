"""Texts made from narrow keys are dealt over tasks by their number, not by the size of the keys' file."""

import pytest
from pyspark.sql import functions as F

from orrery.plans import QUERIES, program_queries, queries, text_queries

SF = "/root/testdata/sf0.001"


def test_rows_of_one_split_are_dealt_evenly(spark, tmp_path):
    spark.range(2500).select(F.col("id").alias("p_partkey"), F.lit("b").alias("p_brand")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    for made in (program_queries.lib_files, text_queries.php_files, text_queries.ui_pages, program_queries.script_pages, queries._program):
        files = made(spark, str(tmp_path))
        sizes = [r["count"] for r in files.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == 4 and sum(sizes) == 2500 and max(sizes) < 700
    assert queries.spread(spark.range(0)).count() == 0


@pytest.mark.parametrize("name", [
    "dependency_tree", "include_targets", "embedded_sql", "flow_steps", "relevant_methods", "method_usage", "facade_methods", "analysis_inputs", "payload_keys", "large_files", "page_summaries", "page_elements", "clickables", "method_records", "facade_rollup", "js_objects", "model_warnings", "model_reports",
])
def test_tasks_follow_the_number_of_texts(spark, monkeypatch, name):
    monkeypatch.setattr(queries, "TEXTS_A_TASK", 20)
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning(10)" in plan
