"""Audits of versions in a log against an outside list, and of recorded revisions against a rebuild."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.dictionary import map_root
from ledgerlens.operators.postings import postings, value_hashes

OK, WARN, BAD = "✅", "⚠️", "❌"


def semver_key(version: Column) -> Column:
    """A sortable form: major, minor, patch, release after pre-releases, then pre-release identifiers, then the text.

    Identifiers of digits come before others and by number; fewer identifiers come first. Invalid versions come before all.
    """
    core = r"^v(0|[1-9]\d*)(?:\.(0|[1-9]\d*))?(?:\.(0|[1-9]\d*))?(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?$"
    part = lambda k: F.coalesce(F.regexp_extract(version, core, k).try_cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    pre = F.regexp_extract(version, core, 4)
    one = lambda x: F.struct((-x.rlike("^[0-9]+$").cast("int")).alias("word"), F.coalesce(x.try_cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")).alias("n"), x.alias("text"))
    return F.struct(
        version.rlike(core).alias("valid"), part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch"), (pre == "").alias("release"),
        F.when(pre == "", F.array().cast("array<struct<word:int,n:decimal(38,0),text:string>>")).otherwise(F.transform(F.split(pre, r"\."), one)).alias("pre"), version.alias("text"),
    )


def duplicate_versions(versions: DataFrame) -> DataFrame:
    """(version, n) of versions that stand in the log twice or more."""
    return versions.groupBy("version").agg(F.count("*").alias("n")).where("n > 1")


def version_report(versions: DataFrame, tags: DataFrame, by: tuple[str, ...] = ("version",)) -> DataFrame:
    """Versions of a module, or of many by (module, version), with (version, idx, mod_hash, zip_hash) beside an outside list (version, tag_mod_hash, tag_zip_hash).

    A version without a tag, or whose tag has no module file, is a warning; a hash that differs is an error.
    """
    known = tags.select(*by, F.lit(True).alias("_tag"), "tag_mod_hash", "tag_zip_hash")
    both = versions.join(known, list(by), "left")
    unknown = F.col("_tag").isNull() | (F.coalesce("tag_mod_hash", F.lit("")) == "")
    glyph = lambda own, other: F.when(unknown, WARN).when(F.col(own).eqNullSafe(F.col(other)), OK).otherwise(BAD)
    return both.select(
        *by, "idx", F.when(F.col("_tag").isNull(), BAD).otherwise(OK).alias("found"),
        glyph("mod_hash", "tag_mod_hash").alias("mod"), glyph("zip_hash", "tag_zip_hash").alias("zip"),
    )


def version_errors(report: DataFrame) -> DataFrame:
    """The rows of a report that are errors, each with what is wrong: a version without a tag, or a hash that differs."""
    wrong = F.array_compact(F.array(*(F.when(F.col(c) == BAD, what) for c, what in (("found", "no tag"), ("mod", "module file differs"), ("zip", "archive differs")))))
    return report.withColumn("errors", wrong).where(F.size("errors") > 0)


def tags_missing_from_log(versions: DataFrame, tags: DataFrame, by: tuple[str, ...] = ("version",)) -> DataFrame:
    """Versions of the outside list that the log lacks."""
    return tags.select(*by).distinct().join(versions.select(*by).distinct(), list(by), "left_anti")


def directory_hash(files: DataFrame) -> DataFrame:
    """(dir, hash) of files (dir, name, content): the hash over each file's hash and name, by name, as ``h1:`` and base64."""
    line = F.concat(F.sha2("content", 256), F.lit("  "), F.col("name"), F.lit("\n"))
    rows = files.groupBy("dir").agg(F.array_sort(F.collect_list(F.struct("name", line.alias("line")))).alias("rows"))
    return rows.select("dir", F.concat(F.lit("h1:"), F.base64(F.unhex(F.sha2(F.array_join("rows.line", ""), 256)))).alias("hash"))


def map_audit(log: DataFrame, map_fn, revisions: list[tuple[int, bytes]]) -> list[tuple[int, bool]]:
    """Each recorded (size, root) against a rebuild from the log's first ``size`` leaves, one for each size."""
    built = {size: map_root(value_hashes(postings(log.where(F.col("idx") < size), map_fn)).select("key_hash", "value_hash")) for size in dict.fromkeys(size for size, _ in revisions)}
    return [(size, built[size] == root) for size, root in revisions]
