"""Lists of courts whose files are several: places and lines run through the whole list."""

import os

import pytest
from pyspark.sql import functions as F

from quarry.plans import files


@pytest.fixture(scope="module")
def spread(spark, sf_dir, tmp_path_factory):
    """The small tables with order numbers twenty times as far apart, so that a court's list is of several files."""
    out = str(tmp_path_factory.mktemp("spread"))
    for name in ("nation", "customer", "orders"):
        rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        rows = rows.withColumn("o_orderkey", F.col("o_orderkey") * 20) if name == "orders" else rows
        rows.write.parquet(os.path.join(out, f"{name}.parquet"))
    return out


@pytest.mark.parametrize("query, place", [("chronological_list", "queue_position"), ("sectioned_list", "queue_position"), ("json_page_list", "queue_position"), ("loose_text_list", "n")])
def test_places_of_a_whole_list(spark, spread, query, place):
    rows = getattr(files, query)(spark, spread).groupBy("court").agg(F.sort_array(F.collect_list(F.col(place).cast("long"))).alias("places")).collect()
    step = 2 if place == "n" else 1
    assert rows and all("-" not in r.court and list(r.places) == list(range(step, step * len(r.places) + 1, step)) for r in rows)
