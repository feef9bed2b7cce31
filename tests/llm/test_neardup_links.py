"""Links of one group that many tasks saw."""

from pyspark.sql import functions as F

from ledgerlens.llm import neardup


def test_edges_of_a_group_are_about_as_many_as_its_nodes(spark):
    """40 tasks, each with a star of its own over the same 400 nodes: 40 * 399 links, and so many rows a join before."""
    stars = spark.range(40 * 400, numPartitions=40).select(F.floor(F.col("id") / 400).cast("long").alias("star"), (F.col("id") % 400).alias("b"))
    links = stars.select((F.col("star") * 7 % 400).alias("a"), "b").where("a <> b")
    forest = neardup._forest(links).cache()
    assert forest.count() > 10_000
    thin = neardup._thinned(neardup._thinned(forest))
    assert thin.count() < 2 * 400 and thin.where("b >= a").isEmpty()
    found = neardup.components(links.union(spark.createDataFrame([(1000, 1001), (1002, 1001)], "a long, b long")))
    assert sorted(map(tuple, found.collect())) == [(i, 0) for i in range(400)] + [(i, 1000) for i in (1000, 1001, 1002)]
