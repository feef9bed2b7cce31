"""Sharding along a Hilbert curve (operator 8), with DataFrame functions only.

Metadata dimensions are quantised to ``bits`` bits each: a number by the quantiles of its column, a string by its rank among the
column's different values, however many, so that neighbouring cells hold neighbouring strings. The cell's place on the Hilbert curve orders the rows, and the
order is cut into runs of equally many rows. Neighbours on the curve are close in every dimension, so each shard spans a small box of
the metadata, and readers can skip files by the minima and maxima of several columns.

The input is read once, into a narrow table of ids and metadata; the text does not move. The order is made by range
partitioning and a sort within partitions; a row's rank is its place there plus the rows of the partitions before it, of which there is one
count a partition. No window sees more than those counts. Of a dimension, at most a value for each cell comes to the driver.

Defined results: a null value is in cell 0 of its dimension; rows in one cell are ordered by the tie columns, nulls first; equal rows
keep any order among themselves; an empty table gives an empty table; columns of the input that have the name of a new one are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import written

BITS = 6


def hilbert_index(cells: Sequence[Column], bits: int) -> Column:
    """The place on the curve of a cell with ``bits`` bits in each dimension (Skilling's transposed form, then interleaved)."""
    n = len(cells)
    masks = [1 << k for k in range(bits - 1, -1, -1)]
    pairs = lambda ms: F.array(*(F.struct(F.lit(q).alias("q"), F.lit(i).alias("i")) for q in ms for i in range(n)))

    def undo(x: Column, s: Column) -> Column:
        own, first, low = F.get(x, s["i"]), F.get(x, F.lit(0)), s["q"] - 1
        hit = own.bitwiseAND(s["q"]) != 0
        swap = first.bitwiseXOR(own).bitwiseAND(low)
        return F.transform(
            x,
            lambda v, j: F.when(j == 0, first.bitwiseXOR(F.when(hit, low).otherwise(swap))).when((j == s["i"]) & ~hit, own.bitwiseXOR(swap)).otherwise(v),
        )

    x = F.array(*(c.cast("int") for c in cells))
    if bits > 1:
        x = F.aggregate(pairs(masks[:-1]), x, undo)

    def interleaved(x: Column) -> Column:
        gray = F.transform(x, lambda v, j: F.aggregate(F.slice(x, F.lit(1), j + 1), F.lit(0), lambda a, b: a.bitwiseXOR(b)))

        def of(g: Column) -> Column:
            last = F.get(g, F.lit(n - 1))
            flip = F.aggregate(F.array(*map(F.lit, masks)), F.lit(0), lambda t, q: F.when(last.bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))
            bit = lambda s, t: F.when(F.get(g, s["i"]).bitwiseXOR(t).bitwiseAND(s["q"]) != 0, 1).otherwise(0)
            index = lambda t: F.aggregate(pairs(masks), F.lit(0).cast("long"), lambda a, s: a * 2 + bit(s, t))
            return F.get(F.transform(F.array(flip), index), F.lit(0))

        return F.get(F.transform(F.array(gray), of), F.lit(0))

    return F.get(F.transform(F.array(x), interleaved), F.lit(0))


def ranked(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``df`` with _rank (from 0, by ``order``) and _all, the number of rows, written to the shared folder."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = (
        df.repartitionByRange(partitions, *order)
        .sortWithinPartitions(*order)
        .withColumn("_id", F.monotonically_increasing_id())
        .select("*", F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND((1 << 33) - 1).alias("_place"))
        .drop("_id")
    )
    placed = written(placed, name)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("_part").agg(F.count("*").alias("_n"))  # a row a partition
    parts = parts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    return placed.join(F.broadcast(parts), "_part").withColumn("_rank", F.col("_before") + F.col("_place")).drop("_part", "_place", "_before")


def quantised(df: DataFrame, column: str, bits: int) -> Column:
    """The cell of ``column`` from 0 to 2**bits - 1; at most a value for each cell comes to the driver."""
    cells = 1 << bits
    if dict(df.dtypes)[column] != "string":
        edges = df.agg(F.percentile_approx(column, [k / cells for k in range(1, cells)], 10_000)).first()[0] or []
        edges = F.array(*map(F.lit, sorted(set(edges)))) if edges else F.array().cast("array<double>")
        return F.coalesce(F.size(F.filter(edges, lambda e: e <= F.col(column))), F.lit(0))
    values = ranked(df.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct(), ["value"], "values")
    cell, before = (F.expr(f"cast(({r}) * {cells} div _all as int)") for r in ("_rank", "_rank - 1"))
    edges = values.where((F.col("_rank") == 0) | (cell > before)).select("value", cell.alias("cell")).orderBy("value").collect()
    if not edges:
        return F.lit(0)
    edges = F.array(*(F.struct(F.lit(r.value).alias("value"), F.lit(r.cell).alias("cell")) for r in edges))
    return F.coalesce(F.try_element_at(F.filter(edges, lambda e: e["value"] <= F.col(column)), F.lit(-1))["cell"], F.lit(0))


def hilbert_sharded(df: DataFrame, dimensions: Sequence[str], ties: Sequence[str], keep: Sequence[str], shards: int, bits: int = BITS) -> DataFrame:
    """``keep`` with curve (the place on the curve), shard (0 to ``shards`` - 1) and slot (gapless from 0) for every row of ``df``."""
    keep = [c for c in keep if c not in ("curve", "shard", "slot")]
    if len(dimensions) * bits > 62:
        raise ValueError("too many bits for one long")
    narrow = written(df.select(*dict.fromkeys([*keep, *ties, *dimensions])), "narrow")
    cells = [quantised(narrow, c, bits) for c in dimensions]
    columns = dict.fromkeys([*keep, *ties])
    placed = ranked(narrow.select(*columns, hilbert_index(cells, bits).alias("curve")), ["curve", *ties], "placed")
    shard = F.expr(f"cast(_rank * {shards} div _all as int)")
    start = F.expr(f"(cast(shard as long) * _all + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard).withColumn("slot", F.col("_rank") - start).select(*keep, "curve", "shard", "slot")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder a shard, rows in order of slot."""
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
