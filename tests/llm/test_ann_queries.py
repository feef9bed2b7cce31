"""Recall of the vector search where queries and rows are not alike."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm.ann import nearest_neighbours


def vectors_of(kind):
    rng, n, d = np.random.default_rng(3), 6000, 32
    x = rng.standard_normal((60, d))[rng.integers(0, 60, n)] * 3 + rng.standard_normal((n, d)) * 0.3
    if kind == "far queries":  # rows lie in clusters, queries anywhere
        x[::100] = rng.standard_normal((n // 100, d)) * 3
    return x + 1e9 if kind == "far from the origin" else x * 1e60 if kind == "huge" else x


@pytest.mark.parametrize("kind", ["far queries", "far from the origin", "huge"])
def test_recall(spark, kind):
    x = vectors_of(kind)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {}
    for r in nearest_neighbours(table, F.col("vec_id") % 100 == 0).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, len(x), 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        hits += len(found[q] & set(np.argsort(d, kind="stable")[:10].tolist()))
    assert hits >= 0.9 * 10 * len(found) and len(found) == 60
