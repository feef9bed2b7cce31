"""The registered queries of the operators: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.ann import nearest_neighbours
from ledgerlens.llm.common import bounded_batches, fold, scratch_path
from ledgerlens.llm.hilbert import hilbert_sharded
from ledgerlens.llm.langid import identify, learn_profiles
from ledgerlens.llm.mil import learn_quality, score_quality
from ledgerlens.llm.mixing import mixed_documents
from ledgerlens.llm.neardup import near_duplicates
from ledgerlens.llm.packing import pack_documents
from ledgerlens.llm.quality_rules import judged
from ledgerlens.llm.token_codes import read_token_files, tokens_at, write_token_files
from ledgerlens.llm.toxicity import learn_toxicity, score_toxicity


def tokenizer_file() -> str:
    """The tokenizer of the token contracts; any other path may be given to the operators."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _held_out(modulus: int, remainder: int) -> Column:
    return F.coalesce(fold("doc_id", modulus) == remainder, F.lit(False)).alias("held_out")


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    profiles = learn_profiles(docs, ~_held_out(4, 2))
    return identify(docs, profiles, keep=["doc_id"]).select("doc_id", _held_out(4, 2), "lang_pred", "score")


def op2_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    write_token_files(_documents(spark, sf_dir), path, tokenizer_file())
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def token_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random access to the files of op2: the ids at a thousand places spread over all documents."""
    path = scratch_path(spark, "tokens")
    write_token_files(_documents(spark, sf_dir), path, tokenizer_file())
    total = spark.read.parquet(f"{path}/manifest").agg(F.sum("n_tokens")).first()[0] or 0
    return tokens_at(spark, path, [total * k // 1000 for k in range(1000)])


#: Target weights of the tree's nodes among their siblings; the others weigh 1.
LANGUAGE_WEIGHTS = {"en": 5.0, "de": 2.0, "fr": 2.0, "es": 1.0}
DOMAINS = ("web", "books", "code", "talk")


def mix_levels() -> dict[str, Column]:
    """Domain, language and source of a document; the tables name no domain, so a source belongs to one by its checksum."""
    domain = F.get(F.array(*map(F.lit, DOMAINS)), (F.crc32("source") % len(DOMAINS)).cast("int"))
    return {"domain": domain, "language": F.col("lang"), "origin": F.col("source")}


def mix_weights() -> dict[tuple[str, ...], float]:
    return {("web",): 4.0, ("books",): 3.0} | {(d, code): w for d in (*DOMAINS, "(none)") for code, w in LANGUAGE_WEIGHTS.items()}


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_documents(_documents(spark, sf_dir), mix_levels(), mix_weights(), keep=["doc_id"], share=0.6, epochs=3)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(_documents(spark, sf_dir), keep=["doc_id"])
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return found.select("doc_id", *counts, "base_failed", "kept")


def op5_ivf_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest_neighbours(vectors, F.col("vec_id") % 100 == 0, k=10)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(_documents(spark, sf_dir), tokenizer_file())
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op7_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = learn_quality(docs, _labels(spark, sf_dir), ~_held_out(5, 0))
    scored = score_quality(docs, model, keep=["doc_id"])
    return scored.select("doc_id", _held_out(5, 0), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = _documents(spark, sf_dir).select(
        "doc_id", "lang", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    keep = ["doc_id", "size", "text_crc32"]
    found = hilbert_sharded(docs, ["lang", "source", "size"], ["text_crc32", "doc_id"], keep, shards=16)
    return found.select(*keep, F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = learn_toxicity(docs, _labels(spark, sf_dir), ~_held_out(5, 0), F.coalesce(fold("doc_id", 5) == 1, F.lit(False)))
    scored = score_toxicity(docs, model, keep=["doc_id"])
    return scored.select("doc_id", _held_out(5, 0), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir), 85, 100)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_langid": op1_langid,
        "op2_token_codes": op2_token_codes,
        "token_access": token_access,
        "op3_mixing": op3_mixing,
        "op4_quality_rules": op4_quality_rules,
        "op5_ivf_pq": op5_ivf_pq,
        "op6_packing": op6_packing,
        "op7_quality_mil": op7_quality_mil,
        "op8_hilbert_shards": op8_hilbert_shards,
        "op9_toxicity": op9_toxicity,
        "op10_neardup": op10_neardup,
    }


def oracle_sql() -> dict[str, str]:
    from ledgerlens.llm.oracle import SQL

    return dict(SQL)
