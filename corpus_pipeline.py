"""A training corpus from ``documents``: language ID, quality rules, near-duplicates, target weights, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns the columns of ``documents``;
the last returns the packed pieces. ``run`` writes each stage's result to the shared folder and reads it again.

Defined results: null and empty texts, and texts without a letter, end at the first stage; of rows that repeat an id and a text one stays, and
rows of one id with different texts are different documents; rows without an id are nobody's near-duplicates; among equals the
smallest id stays; the document in which a leaf's token-prefix ends is cut there; very long texts are taken whole, as the operators
take them; other columns of ``documents`` are dropped; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import bounded_batches, fold, written
from ledgerlens.llm.langid import UNKNOWN, identify, learn_profiles, least_score
from ledgerlens.llm.mixing import mixed_documents
from ledgerlens.llm.neardup import near_duplicates
from ledgerlens.llm.packing import pack_documents
from ledgerlens.llm.quality_rules import judged
from ledgerlens.llm.queries import mix_levels, mix_weights, tokenizer_file

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Rows of ids that a join broadcasts, at most.
MOST_BROADCAST = 1_000_000
#: Bytes of words that the packing stage keeps in each Python worker: less than alone, as the executor's heap has grown in the stages before.
CACHE_BYTES = 40 << 20


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages: what they score at least comes from a fourth of the documents, by profiles of the others."""
    bounded_batches(spark)
    docs = docs.select(COLUMNS)
    held_out = F.coalesce(fold("doc_id", 4) == 0, F.lit(False))
    least = least_score(docs.where(held_out), learn_profiles(docs, ~held_out))
    found = identify(docs, learn_profiles(docs, F.lit(True)))
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select(COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are distributed like their language."""
    return judged(docs, keep=COLUMNS).where("kept").select(COLUMNS)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (0.8 of the 5-word shingles or more), the one with the smallest id; one row of those that repeat it."""
    by = ["doc_id", "text_hash"]
    found = written(near_duplicates(docs, 8, 10, with_hash=True), "groups")
    small = lambda df: F.broadcast(df) if df.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else df
    left = docs.select(*COLUMNS, F.xxhash64("text").alias("text_hash")).join(small(found.where("not kept").select(by).distinct()), by, "left_anti")
    again = written(found.where("kept and doc_id is not null").groupBy(by).count().where("count > 1").select(by), "repeated")
    if again.isEmpty():
        return left.select(COLUMNS)
    again = small(again)
    once = left.join(again, by, "left_semi").dropDuplicates(by)
    return left.join(again, by, "left_anti").unionByName(once).select(COLUMNS)


def weighted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the token-prefixes that bring the sources to their target weights, read once at most; the last of a prefix is cut to its words in it."""
    found = mixed_documents(docs, mix_levels(), mix_weights(), keep=COLUMNS, share=0.8)
    pieces = F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")  # each word with the white space before it
    head = F.array_join(F.slice(pieces, F.lit(1), F.col("take_tokens").cast("int")), "")
    is_cut = F.col("take_tokens") < F.col("n_tokens")
    found = found.where((F.col("take_tokens") > 0) | (F.col("n_tokens") == 0)).withColumn("text", F.when(is_cut, head).otherwise(F.col("text")))
    return found.withColumn("n_chars", F.when(is_cut, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of 4096-token sequences."""
    return pack_documents(docs, tokenizer_file(), cache_bytes=CACHE_BYTES).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", languages),
    ("quality rules", quality),
    ("near-duplicates", distinct),
    ("target weights", weighted),
    ("packing", packed),
]
#: The tokenizer, the hashes and union-find are beyond SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
