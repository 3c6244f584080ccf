"""Pages read the ranges that have them and no others."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from riskweave.operators import display


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Files of many rows, of one, and one with gaps in its places."""
    rows = spark.range(0, 30_000).select(F.when(F.col("id") < 9_000, "b").when(F.col("id") < 9_003, F.concat(F.lit("c"), F.col("id"))).otherwise("d").alias("_file"), F.when(F.col("id") < 9_000, F.col("id")).when(F.col("id") < 9_003, 0).otherwise(2 * (F.col("id") - 9_003)).alias("_row"))
    path = str(tmp_path_factory.mktemp("pages"))
    rows.write.partitionBy("_file").parquet(f"{path}/rows")
    table = spark.read.parquet(f"{path}/rows").withColumn("_file", F.col("_file").cast("string"))
    display.range_counts(table).write.parquet(f"{path}/counts")
    return table, spark.read.parquet(f"{path}/counts"), [(r["_file"], r["_row"]) for r in table.orderBy("_file", "_row").collect()]


@pytest.mark.parametrize(("number", "size"), [(1, 20), (205, 20), (450, 20), (451, 20), (1500, 20), (10**9, 20), (-3, 7), (1, 5000), (3, 5000), (6, 5000)])
def test_pages(stored, number, size):
    table, counts, want = stored
    page = max(1, min(number, -(-len(want) // size)))
    rows = display.page(table, number, size, counts).orderBy("place").collect()
    assert [(r["_file"], r["_row"]) for r in rows] == want[(page - 1) * size : page * size]
    assert [r["place"] for r in rows] == list(range((page - 1) * size + 1, (page - 1) * size + 1 + len(rows)))


@pytest.mark.parametrize("number", [1, 700, 10**6])
def test_a_page_reads_a_bounded_number_of_rows(stored, number):
    table, counts, want = stored
    start = (max(1, min(number, 1500)) - 1) * 20
    ranges = display._within(counts, start, start + 20)
    assert 1 <= len(ranges) <= 2
    df = display.page(table, number, 20, counts)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "SinglePartition" not in plan
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "_row" in scan.split("PushedFilters")[1] and "_file" in scan.split("PartitionFilters")[1].split("PushedFilters")[0]


def test_no_rows(spark):
    table = spark.createDataFrame([], "_file string, _row long")
    assert display.page(table, 3).collect() == []
