"""Approximate nearest neighbours: inverted file with product-quantised residuals (operator 5).

Build. Equal vectors are one entry (its smallest ids are kept, see below). Coarse centroids and the product quantiser's
codebooks are fitted on the driver on a bounded sample, the vectors with the smallest hash: ``LEAST_SAMPLE`` or eight for each of the
lists, of which there are as many as the root of the number of entries, up to ``most_sample`` vectors. Many lists are fitted in two
levels, so the fit costs no more than sample * root of lists. Every vector is indexed: its list is the nearest centroid, its code one byte
for each subspace of the residual.

Search. A query probes the lists nearest to it: so many that, on the sample, they hold the share ``target`` of the true
neighbours (few where vectors lie in clusters, many where they do not), and as many more as hold ``depth`` entries. The depth is measured on
the sample too: so many nearest codes hold that share of the true neighbours in these lists. Both are measured for vectors of the sample and for
some of the queries themselves, and the larger number counts: queries may lie where few rows do. All distances but the last are taken of
vectors that are shifted and scaled to the sample, so none is lost where all lie far from the origin. Lists meet their
queries block by block: a list is dealt into blocks of at most ``block`` entries, and into as many copies as its queries need
blocks, so a crowded list is many tasks. What goes to a block is the query's vector in single precision. A block keeps, by asymmetric distance
tables, the entries within the query's reach, the distance within which the sample lets expect half as many again as the depth (at
least k + 1 of the sample's own entries in the probed lists, so no query comes back short). The nearest codes over all blocks are reranked
by exact distance on the original vectors, in double precision.

An entry keeps the k + 1 smallest ids of its vector: no query can return more of them, nor lose more than its own, and ties go
to the smallest. So a vector that a third of all rows share is one entry and the result is still whole.

Defined results: vectors that are null, empty, zero, or hold nulls or non-finite numbers take no part, nor do those whose length is
not the most frequent one, nor rows without an id; with fewer than k candidates all are returned; a table without valid vectors gives an
empty result; a repeated id with one vector counts once, and with several different ones it asks with the smallest (by its numbers in
order) and can be found by each; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import tidied, written

LEAST_SAMPLE, MOST_SAMPLE = 20_000, 131_072
#: Centroids fitted at one level, at most.
MOST_FLAT = 1024
SUBSPACES = 16
#: Share of true neighbours that the probed lists should hold, as measured on the sample.
TARGET = 0.96
#: Entries reranked, at least.
LEAST_DEPTH = 60
#: Bytes of query vectors that are broadcast, at most.
MOST_BROADCAST = 64 << 20
BLOCK = 8192
#: Vectors of the sample, and as many queries, that the search is measured on.
MEASURED = 256
QUERY_BLOCK = 1024


def valid(vector: Column) -> Column:
    """Vectors that take part: finite, not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's algorithm from distinct random rows; a centroid that loses all its rows is put on one of the worst served."""
    centres = x[rng.permutation(len(x))[:k]].astype(np.float64)
    for _ in range(rounds):
        near, far = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        counts = np.bincount(near, minlength=len(centres))
        empty = np.flatnonzero(counts == 0)
        centres = sums / np.maximum(counts, 1)[:, None]
        centres[empty] = x[np.argsort(-far, kind="stable")[: len(empty)]]
    return centres


def coarse(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """``k`` centroids, or a few more or less; above ``MOST_FLAT`` by clusters and, in each, as many clusters as its share of the rows."""
    if k <= MOST_FLAT:
        return kmeans(x, k, rounds, rng)
    top = kmeans(x, math.isqrt(k), rounds, rng)
    near, _ = nearest(x, top)
    parts = [x[near == c] for c in range(len(top))]
    return np.concatenate([kmeans(p, min(len(p), max(1, round(k * len(p) / len(x)))), rounds, rng) for p in parts if len(p)])


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row and its squared distance, up to a constant of the row."""
    d = (centres * centres).sum(axis=1) - 2 * (x @ centres.T)
    near = d.argmin(axis=1)
    return near, d[np.arange(len(x)), near] + (x * x).sum(axis=1)


@dataclass
class IvfPq:
    """Coarse centroids and codebooks; sizes of the lists once the entries are dealt."""

    centres: np.ndarray
    books: np.ndarray  # subspace, code, dimension
    sample_lists: np.ndarray | None = None
    sample_seen: np.ndarray | None = None  # the sample as its codes show it
    scale: float = 1.0
    shift: np.ndarray | float = 0.0

    def placed(self, x: np.ndarray) -> np.ndarray:
        """Vectors as the index has them."""
        return x / self.scale - self.shift

    @classmethod
    def fit(cls, sample: np.ndarray, lists: int, subspaces: int = SUBSPACES, seed: int = 5) -> IvfPq:
        rng = np.random.default_rng(seed)
        centres = coarse(sample, min(lists, len(sample)), 10, rng)
        rest = sample - centres[nearest(sample, centres)[0]]
        width = -(-sample.shape[1] // subspaces)
        rest = np.pad(rest, ((0, 0), (0, width * subspaces - rest.shape[1])))
        rest = rest[rng.permutation(len(rest))[:LEAST_SAMPLE]]
        books = [kmeans(rest[:, width * s : width * (s + 1)], min(256, len(rest)), 8, rng) for s in range(subspaces)]
        return cls(centres, np.stack(books))

    def probes(self, sample: np.ndarray, asked: np.ndarray, k: int, target: float) -> int:
        """The number of nearest lists that hold the share ``target`` of the k nearest rows of the sample, for ``asked``."""
        d = (sample * sample).sum(axis=1) - 2 * (asked @ sample.T)
        d[_same(sample, asked)] = np.inf
        top = np.argsort(d, axis=1, kind="stable")[:, : min(k, max(1, len(sample) - 1))]
        order = np.argsort((self.centres * self.centres).sum(axis=1) - 2 * (asked @ self.centres.T), axis=1, kind="stable")
        ranks = np.take_along_axis(np.argsort(order, axis=1), nearest(sample, self.centres)[0][top], axis=1)
        return int(np.sort(ranks, axis=None)[math.ceil(target * ranks.size) - 1]) + 1

    def depth(self, sample: np.ndarray, asked: np.ndarray, k: int, target: float, n: int, least: int) -> int:
        """How many nearest codes of n entries hold the share ``target`` of the true neighbours of ``asked``, by their rank among the sample's codes."""
        d = (sample * sample).sum(axis=1) - 2 * (asked @ sample.T)
        own = (self.sample_seen * self.sample_seen).sum(axis=1) - 2 * (asked @ self.sample_seen.T)
        same = _same(sample, asked)
        d[same] = own[same] = np.inf
        # a neighbour's rank in the whole is that of the k / share nearest in the sample, scaled up
        near = min(max(1, math.ceil(k * len(sample) / n)), max(1, len(sample) - 1))
        top = np.argsort(d, axis=1, kind="stable")[:, :near]
        ranks = np.take_along_axis(np.argsort(np.argsort(own, axis=1, kind="stable"), axis=1), top, axis=1)
        rank = np.sort(ranks, axis=None)[math.ceil(target * ranks.size) - 1] + 1
        return max(least, math.ceil(1.2 * rank * n / len(sample)))

    def keep_sample(self, sample: np.ndarray) -> None:
        self.sample_lists, codes = self.encode(sample)
        parts = [book[codes[:, s]] for s, book in enumerate(self.books)]
        self.sample_seen = self.centres[self.sample_lists] + np.concatenate(parts, axis=1)[:, : sample.shape[1]]

    def reach(self, query: np.ndarray, lists: np.ndarray, rank: int, least: int) -> float:
        """The squared distance of the ``rank``-th nearest sample entry in the lists; no limit if they hold fewer than ``least``."""
        own = self.sample_seen[np.isin(self.sample_lists, lists)]
        if len(own) < least:
            return np.inf
        d = ((own - query) ** 2).sum(axis=1)
        rank = min(rank, len(d))
        return float(np.partition(d, rank - 1)[rank - 1]) * (1 + 1e-9)

    def padded(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.books.shape[0] * self.books.shape[2] - x.shape[1])))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The list and the code of each row."""
        near, _ = nearest(x, self.centres)
        rest, width = self.padded(x - self.centres[near]), self.books.shape[2]
        codes = [nearest(rest[:, width * s : width * (s + 1)], book)[0] for s, book in enumerate(self.books)]
        return near, np.stack(codes, axis=1).astype(np.uint8)

    def distances(self, queries: np.ndarray, list_id: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric squared distances of queries to the entries of one list."""
        rest, width = self.padded(queries - self.centres[list_id]), self.books.shape[2]
        out = np.zeros((len(queries), len(codes)))
        for s, book in enumerate(self.books):
            own = rest[:, width * s : width * (s + 1)]
            table = (own * own).sum(axis=1)[:, None] - 2 * own @ book.T + (book * book).sum(axis=1)
            out += table[:, codes[:, s]]
        return out


def _same(sample: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``asked``, place in the sample) of vectors of ``asked`` that the sample has."""
    place = {x.tobytes(): i for i, x in enumerate(sample)}
    found = [(a, place[x.tobytes()]) for a, x in enumerate(asked) if x.tobytes() in place]
    return np.array([f[0] for f in found], np.int64), np.array([f[1] for f in found], np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def fitted(sample: np.ndarray, queries: np.ndarray, n: int, lists: int, k: int, target: float, least_depth: int) -> tuple[IvfPq, int, int]:
    """The index of a sample of n entries, and the lists to probe and codes to rerank as measured on it, for some of it and some ``queries``."""
    scale = float(np.abs(sample).max())
    shift = (sample / scale).mean(axis=0)
    sample, queries = sample / scale - shift, queries / scale - shift
    index = IvfPq.fit(sample, max(1, min(len(sample) // 8, lists)))
    index.scale, index.shift = scale, shift
    sample = sample[:LEAST_SAMPLE]
    index.keep_sample(sample)
    measured = [x for x in (sample[:MEASURED], queries[:MEASURED]) if len(x)]
    probes = max(index.probes(sample, x, k, target) for x in measured)
    depth = max(index.depth(sample, x, k, target + (1 - target) / 2, n, least_depth) for x in measured)
    return index, probes, depth


def nearest_neighbours(
    vectors: DataFrame,
    queries: Column,
    k: int = 10,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    most_sample: int = MOST_SAMPLE,
    target: float = TARGET,
    depth: int = LEAST_DEPTH,
    block: int = BLOCK,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows found for every row where ``queries`` (a condition on ``vectors``) holds."""
    spark = vectors.sparkSession
    sc = spark.sparkContext
    depth = max(depth, k + 1)
    rows = vectors.where(F.col(id_column).isNotNull() & valid(F.col(vector_column))).select(
        F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("is_query")
    )
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("v") == sizes["d"])

    # entries: distinct vectors, each with its smallest ids
    by_vector = Window.partitionBy("v").orderBy("vec_id")
    ids = rows.select("v", "vec_id").withColumn("_r", F.row_number().over(by_vector)).where(F.col("_r") <= k + 1)
    entries = ids.groupBy("v").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")).withColumn("entry", F.get("ids", F.lit(0)))
    entries = written(entries, "entries")
    n = entries.count()
    lists = max(1, math.isqrt(n))
    wanted = min(most_sample, max(LEAST_SAMPLE, 8 * lists))
    sample = _matrix(entries.orderBy(F.xxhash64("v"), "entry").limit(wanted).select("v").toArrow()["v"])
    asked = written(rows.where("is_query").groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v")), "asked")
    some = asked.orderBy(F.xxhash64("v"), "query_id").limit(MEASURED).select("v").toArrow()["v"]
    some = _matrix(some) if len(some) else sample[:0]
    index, probes, depth = fitted(sample, some, n, lists, k, target, depth)
    sample = sample[:LEAST_SAMPLE]
    rank = max(2 * (k + 1), math.ceil(1.5 * depth * len(sample) / n))
    shared = sc.broadcast(index)

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near, codes = shared.value.encode(shared.value.placed(_matrix(batch["v"])))
                yield pa.RecordBatch.from_arrays(
                    [batch["entry"], pa.array(near.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())], ["entry", "list", "code"]
                )

    coded = written(entries.select("entry", "v").mapInArrow(tidied(encode), "entry long, list int, code binary"), "codes")
    held = np.zeros(len(index.centres), np.int64)
    for r in coded.groupBy("list").count().collect():  # a row a list, at most most_sample / 8
        held[r["list"]] = r["count"]

    def probe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, centres = shared.value.placed(_matrix(batch["v"])), shared.value.centres
            order = np.argsort((centres * centres).sum(axis=1) - 2 * (x @ centres.T), axis=1, kind="stable")
            reach = np.cumsum(held[order], axis=1)
            stop = np.maximum(probes, (reach < min(depth, n)).sum(axis=1) + 1).clip(max=len(centres))
            rows_of = np.repeat(np.arange(len(x)), stop)
            found = np.concatenate([o[:s] for o, s in zip(order, stop, strict=True)]).astype(np.int32)
            reach = np.array([shared.value.reach(q, o[:s], rank, k + 1) for q, o, s in zip(x, order, stop, strict=True)])
            yield pa.RecordBatch.from_arrays(
                [batch["query_id"].take(pa.array(rows_of)), pa.array([v.tobytes() for v in x.astype(np.float32)], pa.binary()).take(pa.array(rows_of)), pa.array(found), pa.array(reach[rows_of])],
                ["query_id", "v", "list", "reach"],
            )

    probed = written(asked.mapInArrow(tidied(probe), "query_id long, v binary, list int, reach double"), "probed")
    wanted = np.zeros(len(index.centres), np.int64)
    for r in probed.groupBy("list").count().collect():
        wanted[r["list"]] = r["count"]
    parts = np.maximum(1, -(-held // block))
    copies = np.maximum(1, -(-wanted // (QUERY_BLOCK * 16)))
    dealt = spark.createDataFrame(pd.DataFrame({"list": np.arange(len(parts), dtype=np.int32), "parts": parts.astype(np.int32), "copies": copies.astype(np.int32)}))
    dealt = F.broadcast(dealt)  # a row a list
    left = coded.join(dealt, "list").select("entry", "code", "list", F.pmod(F.hash("entry"), "parts").alias("part"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    right = probed.join(dealt, "list").select("query_id", "v", "list", "reach", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.hash("query_id"), "copies").alias("copy"))

    def scan(key: tuple, own: pa.Table, asks: pa.Table) -> pa.Table:
        out_q, out_e, out_d = [], [], []
        if own.num_rows and asks.num_rows:
            entry = np.asarray(own["entry"])
            order = np.argsort(entry, kind="stable")  # ties of equal codes: the smaller entry first
            entry = entry[order]
            codes = np.frombuffer(b"".join(own["code"].to_pylist()), np.uint8).reshape(len(entry), -1)[order]
            q, reach = np.asarray(asks["query_id"]), np.asarray(asks["reach"])
            x = np.frombuffer(b"".join(asks["v"].to_pylist()), np.float32).reshape(len(q), -1).astype(np.float64)
            for a in range(0, len(q), QUERY_BLOCK):
                d = shared.value.distances(x[a : a + QUERY_BLOCK], key[0].as_py(), codes)
                if d.shape[1] > depth:  # no query needs more of one block
                    np.put_along_axis(d, np.argsort(d, axis=1, kind="stable")[:, depth:], np.nan, axis=1)
                rows_, columns = np.nonzero(d <= reach[a : a + QUERY_BLOCK, None])
                out_q.append(q[a + rows_])
                out_e.append(entry[columns])
                out_d.append(d[rows_, columns])
        join = lambda x, kind: pa.array(np.concatenate(x) if x else [], kind)
        return pa.table({"query_id": join(out_q, pa.int64()), "entry": join(out_e, pa.int64()), "d": join(out_d, pa.float64())})

    by = ["list", "part", "copy"]
    near = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(scan, "query_id long, entry long, d double")
    best = Window.partitionBy("query_id").orderBy("d", "entry")
    near = near.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= depth).select("query_id", "entry")

    # exact distances on the original vectors
    few = asked.limit(MOST_BROADCAST // (8 * sizes["d"]) + 1).count() <= MOST_BROADCAST // (8 * sizes["d"])
    pairs = near.join(entries, "entry").select("query_id", "ids", F.col("v").alias("e")).join(F.broadcast(asked) if few else asked, "query_id")

    def rerank(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = _matrix(batch["v"]) - _matrix(batch["e"]) if batch.num_rows else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([batch["query_id"], batch["ids"], pa.array(np.sqrt((d * d).sum(axis=1)))], ["query_id", "ids", "score"])

    exact = pairs.select("query_id", "ids", "v", "e").mapInArrow(tidied(rerank), "query_id long, ids array<long>, score double")
    exact = exact.select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    last = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return exact.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
