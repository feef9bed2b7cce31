"""Key extraction: a leaf becomes zero or more keys. Each function takes the leaf column and gives ARRAY<STRING>.

``REGISTRY`` names them for the index, which records the name in its manifest: one index keeps one function for life.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.domains import DEFAULT, SuffixRules, with_parents
from ledgerlens.functions.hashing import key_hash

#: Fixed pattern: pseudo-versions as the public module documentation defines them.
PSEUDO_VERSION = r"^v[0-9]+\.(0\.0-|\d+\.\d+-([^+]*\.)?0\.)\d{14}-[A-Za-z0-9]+(\+[0-9A-Za-z-]+(\.[0-9A-Za-z-]+)*)?$"
_NO_KEYS = "array<string>"

MapFn = Callable[[Column], Column]


def text_of(leaf: Column) -> Column:
    return F.decode(leaf, "UTF-8")


def before_colon(leaf: Column) -> Column:
    """The text before the first colon; a leaf without one is an error."""
    text = text_of(leaf)
    return F.when(F.contains(text, F.lit(":")), F.array(F.substring_index(text, ":", 1))).otherwise(F.raise_error(F.concat(F.lit("no colon in leaf: "), text)).cast(_NO_KEYS))


def comma_list(leaf: Column) -> Column:
    """The comma-separated names before the first colon; none for a blank one or ``empty``."""
    names = F.substring_index(text_of(leaf), ":", 1)
    return F.when(names.isin("", "empty"), F.array().cast(_NO_KEYS)).otherwise(F.split(names, ","))


def json_field(name: str) -> MapFn:
    """A field of a JSON object, empty if it is missing; text that is no JSON object is an error."""

    def keys(leaf: Column) -> Column:
        text = text_of(leaf)
        parsed = F.try_parse_json(text)
        ok = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
        value = F.coalesce(F.get_json_object(text, f"$.{name}"), F.lit(""))
        return F.when(ok, F.array(value)).otherwise(F.raise_error(F.concat(F.lit("not a JSON object: "), text)).cast(_NO_KEYS))

    return keys


def module_line(leaf: Column) -> Column:
    """The module of a leaf ``<module> <version> ...``; none for pseudo-versions; an error without two spaces."""
    text = text_of(leaf)
    version = F.split_part(text, F.lit(" "), F.lit(2))
    found = F.when(F.contains(version, F.lit("-")) & version.rlike(PSEUDO_VERSION), F.array().cast(_NO_KEYS)).otherwise(F.array(F.split_part(text, F.lit(" "), F.lit(1))))
    return F.when(text.rlike("(?s)^[^ ]* [^ ]* "), found).otherwise(F.raise_error(F.concat(F.lit("malformed module leaf: "), text)).cast(_NO_KEYS))


def hosts_by(rules: SuffixRules) -> MapFn:
    """The host of a URL and its parent domains, by the suffix rules."""
    return lambda leaf: with_parents(F.filter(F.array(F.parse_url(text_of(leaf), F.lit("HOST"))), lambda x: x.isNotNull()), rules)


def certificate_names_by(rules: SuffixRules) -> MapFn:
    """DNS names of a certificate log leaf with their parent domains."""
    from ledgerlens.functions.certificates import log_leaf_names

    return lambda leaf: with_parents(log_leaf_names(leaf), rules)


def tree_certificate_names_by(rules: SuffixRules) -> MapFn:
    """DNS names of a Merkle tree certificate entry with their parent domains."""
    from ledgerlens.functions.certificates import tree_entry_names

    return lambda leaf: with_parents(tree_entry_names(leaf), rules)


def url_hosts(leaf: Column) -> Column:
    return hosts_by(DEFAULT)(leaf)


def certificate_names(leaf: Column) -> Column:
    return certificate_names_by(DEFAULT)(leaf)


def tree_certificate_names(leaf: Column) -> Column:
    return tree_certificate_names_by(DEFAULT)(leaf)


REGISTRY: dict[str, MapFn] = {
    "before_colon": before_colon,
    "comma_list": comma_list,
    "json_module": json_field("module"),
    "module_line": module_line,
    "url_hosts": url_hosts,
    "certificate_names": certificate_names,
    "tree_certificate_names": tree_certificate_names,
}


def fingerprint(spark: SparkSession, map_fn: MapFn) -> str:
    """A hash over what a function does: the expression that it makes of a leaf, as Spark resolves it. Functions that call Python count by their name."""
    leaf = spark.createDataFrame([], "leaf binary")
    shown = leaf.select(map_fn(F.col("leaf")).alias("keys"))._jdf.queryExecution().analyzed().toString()
    shown = re.sub(r"#\d+L?|_\d+", "", shown)
    return hashlib.sha256(re.sub(r"\s+", " ", shown).encode()).hexdigest()


def key_hashes(keys: Column) -> Column:
    return F.transform(keys, key_hash)
