"""Costly columns are computed one time a row, and by more tasks than the input has files."""

import pytest

from quarry.plans import files as file_plans
from quarry.plans import pages as page_plans


@pytest.mark.parametrize("query", [file_plans.delimited_list, file_plans.chronological_list, file_plans.json_page_list, file_plans.process_subjects, page_plans.open_data_links, page_plans.sectioned_links, page_plans.document_links], ids=lambda f: f.__name__)
def test_filters_repeat_no_expression(spark, sf_dir, query):
    plan = query(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    tests = [x for x in plan.splitlines() if x.lstrip(" :+-").startswith("Filter")]
    assert not any("from_json" in x or "translate(" in x or "regexp_extract_all" in x or "map_from_entries" in x for x in tests)


def test_numbered_list_makes_its_rows_once(spark, sf_dir):
    plan = file_plans.numbered_budget_list(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert not any("map_from_entries" in x for x in plan.splitlines() if x.lstrip(" :+-").startswith("Filter"))


def test_heavy_rows_are_dealt_out(spark, sf_dir):
    from pyspark.sql import functions as F

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for rows in (page_plans._page(spark, sf_dir, F.lit("x")), file_plans._hits(spark, sf_dir)):
        assert rows.rdd.getNumPartitions() == n
