"""Tables as logs: any table with gapless positions, text logs of postings, and a seeded synthetic log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.functions.codec import wal_parsed, wal_row


def table_log(df: DataFrame, leaf: Column, idx: Column) -> DataFrame:
    """(idx, leaf) of a table that has positions."""
    return df.select(idx.cast("long").alias("idx"), F.encode(leaf, "UTF-8").alias("leaf"))


def numbered_log(df: DataFrame, leaf: Column, order: list[str]) -> DataFrame:
    """(idx, leaf) with positions by a total order: range partitions, a sort inside them, and one count a partition."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(*order, F.encode(leaf, "UTF-8").alias("leaf")).repartitionByRange(n, *order).sortWithinPartitions(*order)
    rows = rows.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))  # a row a partition
    return rows.join(F.broadcast(counts), "_part").select((F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1)).alias("idx"), "leaf")


def text_rows(postings: DataFrame) -> DataFrame:
    """(value): the text form of postings (key_hash, idx, ord), a row for each leaf that has keys."""
    by = postings.groupBy("idx").agg(F.array_sort(F.collect_list(F.struct("ord", "key_hash"))).alias("k"))
    return by.select("idx", wal_row(F.col("idx"), F.col("k.key_hash")).alias("value"))


def from_text(rows: DataFrame) -> DataFrame:
    """Postings of text rows (value); a malformed row is an error."""
    parsed = rows.select(wal_parsed(F.col("value")).alias("r"))
    return parsed.select(F.col("r.idx").alias("idx"), F.posexplode("r.hashes").alias("ord", "key_hash")).select("key_hash", "idx", "ord")


def repaired_text(rows: DataFrame, tree_size: int) -> DataFrame:
    """Rows (value, in file order by ``line``; ``ended`` tells whether a line end follows) below a size, an unended tail dropped.

    A blank or malformed row that a line end follows is an error, as is a NUL.
    """
    whole = rows.where("ended")
    return whole.select("line", F.col("value"), wal_parsed(F.col("value")).alias("r")).where(F.col("r.idx") < tree_size).select("line", "value")


def synthetic_log(spark: SparkSession, n: int, seed: int = 12345, repeats: float = 0.5) -> DataFrame:
    """(idx, leaf) ``<key>: <idx>`` where, with the chance ``repeats``, the key is one that an earlier leaf introduced."""
    i = F.col("id")
    u = lambda salt: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), i), F.lit(1 << 30)) / (1 << 30)
    key = F.when((u(1) < repeats) & (i > 0), F.floor(u(2) * i)).otherwise(i)
    return spark.range(n).select(i.alias("idx"), F.encode(F.concat(F.lit("key-"), key.cast("string"), F.lit(": "), i.cast("string")), "UTF-8").alias("leaf"))


def synthetic_modules(rows: DataFrame, seed: int = 7) -> DataFrame:
    """(idx, leaf) of rows (value long, timestamp), as of the ``rate`` source: module, version and hash as a JSON object."""
    names = F.array(*map(F.lit, ("alpha", "beta", "gamma", "delta")))
    module = F.get(names, F.pmod(F.xxhash64(F.lit(seed), "value"), F.lit(4)).cast("int"))
    version = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    digest = F.base64(F.unhex(F.sha2(F.concat(module, version), 256)))
    return rows.select(F.col("value").alias("idx"), F.encode(F.to_json(F.struct(module.alias("module"), version.alias("version"), digest.alias("hash"))), "UTF-8").alias("leaf"))
