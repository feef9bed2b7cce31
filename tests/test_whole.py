"""Logs beyond the driver's tables."""

from pyspark.sql import functions as F

from conftest import SF
from ledgerlens import queries
from ledgerlens.plans import demo


def test_deep_tiles_are_read_back(spark):
    """Tiles 999 to 1001, the last of them partial: the path gets a folder between the first and the second."""
    first, end = 999 * 256, 1001 * 256 + 44
    log = spark.range(first, end).select(F.col("id").alias("idx"), F.encode(F.concat(F.lit("leaf "), F.col("id").cast("string")), "UTF-8").alias("leaf"))
    found = demo._tiles_again(log, first, end).collect()
    assert sorted((r.idx, r.leaf) for r in found) == [(i, f"leaf {i}") for i in range(first, end)]


def test_lookups_read_the_index(spark):
    """Lookups read the sorted postings with the key pushed down, never the log."""
    plan = queries.lookup_many(spark, SF)._jdf.queryExecution().toString()
    assert "events.parquet" not in plan and "/postings/" in plan and "In(key_hash" in plan.replace("PushedFilters: [", "")
