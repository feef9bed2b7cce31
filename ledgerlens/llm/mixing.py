"""Mixing sources to target weights by hierarchical budgeting (operator 3).

The sources form a tree: domain, language, source. A node's budget goes to its children by their weights; a child that has fewer
tokens than its share takes what it has, and the shortage goes to its siblings by their weights, until they are full
too. A node's supply is what lies below it, so only what all its children together cannot take reaches its own siblings: shortages
are filled by siblings before ancestors. Supply is the tokens of a leaf times the number of epochs it may be read.

A leaf reads its documents in epochs. Each epoch has its own order, by a hash of the seed, the epoch, the document's id and its
text, which every row carries as ``place``: reading a leaf by (epoch, place) replays its epochs. The budget is a token-prefix of
them: whole epochs, then the documents of the next one up to the budget, the last one cut.

Only totals per leaf (at most ``most_leaves``, which is checked) come to the driver. Where a leaf's prefix ends is found in three steps: sums over
equal spans of the hash, over the ``SPAN_RANGES`` ranges of the one span where the budget ends, then the documents of the one range. So a leaf
that holds a third of all rows is summed by many tasks and no window sees more than rows / (``RANGE_ROWS`` * ``SPAN_RANGES``), ``SPAN_RANGES``, or
some ``RANGE_ROWS`` rows of it; no text is shuffled: the choice is a comparison with the leaf's end. Texts are read and counted once, and
once more only if ``keep`` asks for them.

Defined results: a null level is the node ``(none)``; a document without tokens is chosen if the prefix reaches it; rows with equal id and
text stand at one place and share the tokens left there evenly; a weight of 0 excludes a node, a weight not given is 1; a budget
above the supply takes everything; a text of any length is one number of tokens; an empty table gives an empty table; columns of the input named like the new ones are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import written

NONE = "(none)"
MOST_LEAVES = 100_000
#: Rows of a leaf in one range of the hash, about.
RANGE_ROWS = 2000
#: Ranges in one span.
SPAN_RANGES = 1000
_ALL = 1 << 53

Path = tuple[str, ...]


def filled(budget: int, weights: Sequence[float], supply: Sequence[int]) -> list[int]:
    """``budget`` shared by weight among siblings, none above its supply; whole numbers, the largest fractions rounded up."""
    out = [0] * len(weights)
    open_ = [i for i, w in enumerate(weights) if w > 0 and supply[i] > 0]
    left = min(budget, sum(supply[i] for i in open_))
    while open_:
        total = math.fsum(weights[i] for i in open_)
        full = [i for i in open_ if supply[i] * total <= left * weights[i]]
        if not full:
            shares = {i: left * weights[i] / total for i in open_}
            for i in open_:
                out[i] = int(shares[i])
            for i in sorted(open_, key=lambda i: (out[i] - shares[i], i))[: left - sum(out[i] for i in open_)]:
                out[i] += 1
            break
        for i in full:
            out[i] = supply[i]
            left -= supply[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def budgets(supply: Mapping[Path, int], weights: Mapping[Path, float], total: int) -> dict[Path, int]:
    """The budget of each leaf; ``weights`` has a node's weight among its siblings by its path from the root."""
    children: dict[Path, set[Path]] = {}
    below: dict[Path, int] = {}
    for leaf, n in supply.items():
        if all(weights.get(leaf[: k + 1], 1.0) > 0 for k in range(len(leaf))):
            below[leaf] = n
            for k in range(len(leaf)):
                children.setdefault(leaf[:k], set()).add(leaf[: k + 1])
                below[leaf[:k]] = below.get(leaf[:k], 0) + n
    out = dict.fromkeys(supply, 0)
    todo: list[tuple[Path, int]] = [((), total)]
    while todo:
        node, budget = todo.pop()
        if node not in children:
            if node in out:
                out[node] = budget
            continue
        own = sorted(children[node])
        todo += zip(own, filled(budget, [weights.get(c, 1.0) for c in own], [below[c] for c in own]), strict=True)
    return out


def _place(seed: int, epoch: str) -> Column:
    """Where a document stands in the order of a leaf's epoch: 53 bits of a hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(epoch).cast("long"), F.col("doc_id"), F.col("_text")), 11)


def words(text: str = "text") -> Column:
    """Tokens as words between white space."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.length(trimmed) > 0, F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).otherwise(0).cast("long")


def mixed_documents(
    docs: DataFrame,
    levels: Mapping[str, Column],
    weights: Mapping[Path, float],
    keep: Sequence[str],
    share: float = 1.0,
    total: int | None = None,
    epochs: int = 1,
    tokens: Column | None = None,
    seed: int = 17,
    most_leaves: int = MOST_LEAVES,
) -> DataFrame:
    """``keep`` and the levels with epoch, place, n_tokens and take_tokens for every document (doc_id, text) chosen, once for each epoch.

    The budget is ``total`` tokens, or else ``share`` of all tokens. ``levels`` names the tree's levels from the root down.
    """
    tokens = words() if tokens is None else tokens
    names = list(levels)
    node = [F.coalesce(c.cast("string"), F.lit(NONE)).alias(f"_{n}") for n, c in levels.items()]
    own = [f"_{n}" for n in names]
    new = (*names, "epoch", "place", "n_tokens", "take_tokens")
    keep = [c for c in keep if c not in new]
    narrow_keep = [] if "text" in keep else [c for c in keep if c != "doc_id"]
    narrow = written(docs.select(*node, "doc_id", *narrow_keep, F.xxhash64("text").alias("_text"), tokens.alias("_tokens")), "tokens")
    leaves = narrow.groupBy(*own).agg(F.sum("_tokens").alias("tokens"), F.count("*").alias("rows")).limit(most_leaves + 1).collect()
    if len(leaves) > most_leaves:
        raise ValueError(f"more than {most_leaves} leaves")
    supply = {tuple(r[: len(own)]): r["tokens"] * epochs for r in leaves}
    given = budgets(supply, weights, int(share * sum(r["tokens"] for r in leaves)) if total is None else total)
    rows = []
    for r in leaves:
        whole, rest = divmod(given[tuple(r[: len(own)])], r["tokens"]) if r["tokens"] else (0, 0)
        rows.append((*r[: len(own)], int(whole), int(rest), max(1, -(-r["rows"] // RANGE_ROWS))))
    spark = docs.sparkSession
    schema = ", ".join([*(f"{c} string" for c in own), "_whole int", "_rest long", "_ranges long"])
    plan = F.broadcast(spark.createDataFrame(rows, schema))  # a row a leaf, at most most_leaves

    # where the prefix of the last, partly read epoch ends
    placed = narrow.join(plan.where("_rest > 0"), own).withColumn("_place", _place(seed, "_whole"))
    placed = placed.withColumn("_range", F.floor(F.col("_place") * F.col("_ranges") / _ALL).cast("long")).withColumn("_span", F.expr(f"_range div {SPAN_RANGES}"))
    placed = written(placed.select(*own, "_rest", "_span", "_range", "_place", "_tokens"), "placed")

    def holding(rows: DataFrame, within: list[str], step: str) -> DataFrame:
        """The one ``step`` of each leaf where its budget ends, with _before: the tokens that stand before it."""
        window = Window.partitionBy(*within).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
        given = ["_before"] if "_before" in rows.columns else []
        sums = rows.groupBy(*within, "_rest", *given, step).agg(F.sum("_tokens").alias("_n"), F.count("*").alias("_rows"))
        before = F.coalesce(F.sum("_n").over(window), F.lit(0)) + (F.col("_before") if given else F.lit(0))
        return sums.withColumn("_before", before).where((F.col("_before") < F.col("_rest")) & (F.col("_before") + F.col("_n") >= F.col("_rest")))

    span = holding(placed, own, "_span").select(*own, "_span", "_before")
    range_ = holding(placed.join(F.broadcast(span), [*own, "_span"]), [*own, "_span"], "_range").select(*own, "_range", "_before")
    ends = holding(placed.join(F.broadcast(range_), [*own, "_range"]), [*own, "_range"], "_place")
    ends = ends.select(*own, F.col("_place").alias("_end"), ((F.col("_rest") - F.col("_before")) / F.col("_rows")).cast("long").alias("_cut"))
    plan = written(plan.join(ends, own, "left").select(*own, "_whole", "_end", "_cut"), "plan")

    rows = docs.select(*dict.fromkeys([*keep, "doc_id"]), *node, F.xxhash64("text").alias("_text"), tokens.alias("_tokens")) if "text" in keep else narrow
    found = rows.join(F.broadcast(plan), own).withColumn("_last", _place(seed, "_whole"))
    times = F.col("_whole") + F.coalesce(F.col("_last") <= F.col("_end"), F.lit(False)).cast("int")
    found = found.withColumn("_times", times).where("_times > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("_times") - 1)))
    at_end = F.coalesce(F.col("_last") == F.col("_end"), F.lit(False)) & (F.col("epoch") == F.col("_whole"))
    cut = F.when(at_end, F.least("_tokens", "_cut")).otherwise(F.col("_tokens"))
    return found.select(*keep, *(F.col(f"_{n}").alias(n) for n in names), "epoch", _place(seed, "epoch").alias("place"), F.col("_tokens").alias("n_tokens"), cut.alias("take_tokens"))
