"""Near-duplicate groups by SuperMinHash, banding, verification and union-find (operator 10).

A document's set is its distinct runs of ``width`` words (A-Z as a-z). SuperMinHash gives each element a random permutation of the
signature's places: step j offers the value j + u to the j-th of them, and a place keeps its least value. The ranks are correlated (no
two values of an element fall on one place), which lowers the variance, and once every place is filled no later step can change
any, so the steps stop there; a document of n elements takes about m log(m) / n of them.

Stages, each written to the shared folder:

1. One pass over the texts gives per document the size and a fingerprint of its set, and its bands.
2. Documents with equal sets are one class with a number of its own; only classes go on, so a group of copies
   of any size is one row. Classes with equal bands are in one bucket.
3. Each bucket sends its members to one hub, the member that shares most buckets with others: the original of a family of edited
   copies. These pairs are confirmed on the full sets, read again from the texts of the documents concerned only, and union-find
   makes components of the links.
4. A bucket that now lies in one component has nothing to add. The members of the others form families (joined by such buckets). A
   family is compared as a whole, or bucket by bucket where that sends fewer rows (then rows grow with the family, as long as its buckets
   do not), in cells of at most ``CELL`` texts of like size, two cells a task. First only signatures go there, and what comes back is
   which texts have a partner, of another component, near the threshold; then their sets follow them into the same cells, where
   such pairs are confirmed and only links leave the task. So every pair that shares a bucket is decided, and no pair is ever a row but
   those with a hub and the links. A bucket of k texts, more than a cell, sends k * k / ``CELL`` signatures.

The bands' length and number follow from the threshold so that a pair exactly at it is missed with probability ``most_missed``. Pairs
whose sizes alone rule the threshold out are not confirmed, nor (in step 4) those whose signatures agree in fewer places than
a pair at the threshold would by 6.5 standard deviations; nothing else is left out.

Union-find is distributed: tasks first reduce their own links to a forest. What a node then still has of them, one smaller node from each task
that saw it, becomes one: the smallest, to which the others are linked instead; these few links are reduced in the same way. So the edges
are about as many as the nodes, however many tasks or buckets a group was dealt over. Then rounds of joins point every node at the
smallest node that its neighbours know and that node's own pointer, until nothing changes. No link or component reaches the driver.
Joins on a band, a node or a label deal the rows of a key that has more than ``HOT`` over many tasks and copy the other
side's one row to each of them.

Defined results: null and empty texts, and texts of white space, have an empty set and are linked with nothing; a text shorter than
``width`` words is one element; repeated rows are in one class; rows of one doc_id with different texts are judged each by its own
text, and count as one document no more than any others do; rows without doc_id are linked with nothing and have no
component; a very long text is hashed in pieces, so that beside it only some 40 bytes a word are held; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import hashed_words, in_chunks, mixed, shingle_hashes, tidied, utf8, written
from ledgerlens.llm.tokens import forget

WIDTH = 5
MOST_MISSED = 1e-8
CELL = 2048
#: Bytes of the sets of one cell, about; one text at least.
CELL_BYTES = 32 << 20
#: Rows of one key that one task of a join takes, about.
HOT = 100_000
#: Keys with more rows than that, at most, that are broadcast; beyond it all rows meet unsalted.
MOST_HOT = 1_000_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def bands_for(threshold: float, most_missed: float = MOST_MISSED) -> tuple[int, int]:
    """(rows, bands): the longest bands, of at most 8 places, whose number for that chance of a miss is at most 64."""
    for rows in range(8, 0, -1):
        bands = math.ceil(math.log(most_missed) / math.log1p(-(threshold**rows)))
        if bands <= 64:
            return rows, bands
    raise ValueError("the threshold is too low for banding")


def shingle_sets(items: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """The set of each text, as sorted 64-bit fingerprints."""
    words, _, first = hashed_words(items)
    return [np.unique(shingle_hashes(words[a:b], width)) for a, b in zip(first[:-1], first[1:], strict=True)]


def fingerprint(s: np.ndarray) -> bytes:
    """24 bytes that name a set."""
    return np.array([s.sum(), mixed(s ^ _STEP).sum(), len(s)], np.uint64).tobytes()


def superminhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """Signatures of non-empty sets, a row each, all steps taken for many documents at once.

    A value j + u stands as one integer, j above 48 bits of u, so that equal values mean equal elements.
    """
    n = len(sets)
    out = np.full(n * m, np.iinfo(np.uint64).max, np.uint64)
    elements = np.concatenate(sets)
    of = np.repeat(np.arange(n), [len(s) for s in sets])
    order: np.ndarray | None = None
    with np.errstate(over="ignore"):
        for j in range(m):
            state = mixed(elements + np.uint64(j + 1) * _STEP)
            u = state >> np.uint64(16)
            k = j + ((mixed(state ^ _STEP) >> np.uint64(32)) * np.uint64(m - j) >> np.uint64(32)).astype(np.int64)
            if j == 0:
                place = k
            else:
                rows = np.arange(len(elements))
                place = order[rows, k].astype(np.int64)
                order[rows, k] = order[:, j]
                order[:, j] = place
            np.minimum.at(out, of * m + place, np.uint64(j) << np.uint64(48) | u)
            filled = (out.reshape(n, m) != np.iinfo(np.uint64).max).all(axis=1)
            left = ~filled[of]
            if not left.any():
                break
            if j == 0:
                elements, of, k = elements[left], of[left], k[left]
                order = np.tile(np.arange(m, dtype=np.int16), (len(elements), 1))
                order[np.arange(len(elements)), k] = 0
                order[:, 0] = k
            elif not left.all():
                elements, of, order = elements[left], of[left], order[left]
    return out.reshape(n, m)


def signed(docs: DataFrame, rows: int, bands: int, width: int = WIDTH) -> DataFrame:
    """doc_id, text_hash, n_shingles, print (fingerprint of the set; null if empty), bands (a 64-bit key for each band)."""
    m = rows * bands
    salts = mixed(np.arange(1, bands + 1, dtype=np.uint64))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in in_chunks(iter(batches), "text", 128 << 10):
            sets = shingle_sets(utf8(batch["text"]), width)
            full = [s for s in sets if len(s)]
            keys = np.zeros((len(full), bands), np.uint64)
            if full:
                places = superminhash(full, m).reshape(len(full), bands, rows)
                for k in range(rows):
                    keys = mixed(keys * _STEP + places[:, :, k] + salts)
            keys, at = keys.view(np.int64), 0
            prints, own = [], []
            for s in sets:
                if len(s):
                    prints.append(fingerprint(s))
                    own.append(keys[at])
                    at += 1
                else:
                    prints.append(None)
                    own.append(None)
            sizes = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["text_hash"], sizes, pa.array(prints, pa.binary()), pa.array(own, pa.list_(pa.int64()))],
                ["doc_id", "text_hash", "n_shingles", "print", "bands"],
            )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    return texts.mapInArrow(tidied(run), "doc_id long, text_hash long, n_shingles long, print binary, bands array<long>")


def _sets_of(docs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """(cid, set) of ``classes`` (cid, doc_id, print), from the text of that document that has that fingerprint; a set as little-endian bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_chunks(iter(batches), "text", 256 << 10):
            sets = shingle_sets(utf8(batch["text"]), width)
            prints = pa.array([fingerprint(s) for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], prints, pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "print", "set"])

    few = classes.limit(1_000_001).count() <= 1_000_000
    small = F.broadcast if few else lambda x: x
    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(small(classes.select("doc_id").distinct()), "doc_id", "left_semi")
    found = wanted.mapInArrow(tidied(run), "doc_id long, print binary, set binary").join(small(classes), ["doc_id", "print"])
    return found.select("cid", "set").dropDuplicates(["cid"])  # repeated rows


def confirmed(docs: DataFrame, pairs: DataFrame, classes: DataFrame, numerator: int, denominator: int, width: int = WIDTH) -> DataFrame:
    """Those of ``pairs`` (a, b) of ``classes`` (cid, doc_id, print) whose sets have intersection * denominator >= union * numerator."""
    ids = pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct()
    sets = written(_sets_of(docs, written(classes.select("cid", "doc_id", "print").join(ids, "cid"), "ids"), width), "sets")
    joined = meeting(pairs.withColumnRenamed("b", "cid"), sets, "cid").select("a", F.col("cid").alias("b"), F.col("set").alias("set_b"))
    counts = pairs.groupBy(F.col("a").alias("cid")).agg(F.count("*").alias("members"))
    joined = meeting(joined.withColumnRenamed("a", "cid"), sets, "cid", counts).withColumnsRenamed({"cid": "a", "set": "set_a"})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["set_a"], batch["set_b"], strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate((p, q))
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(common * denominator >= (len(p) + len(q) - common) * numerator)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return joined.select("a", "b", "set_a", "set_b").mapInArrow(tidied(run), "a long, b long")


def meeting(rows: DataFrame, single: DataFrame, key: str | list[str], counts: DataFrame | None = None) -> DataFrame:
    """``rows`` joined with ``single``, which has one row a key. The rows of a key with more than ``HOT`` are dealt over tasks, each with a
    copy of the single row. ``counts`` (key, members) has the rows of each key, at least, where these are known."""
    by = [key] if isinstance(key, str) else key
    counts = rows.groupBy(*by).agg(F.count("*").alias("members")) if counts is None else counts
    hot = counts.where(F.col("members") > HOT).select(*by, F.ceil(F.col("members") / HOT).cast("int").alias("_parts"))
    if not 0 < hot.limit(MOST_HOT + 1).count() <= MOST_HOT:
        return rows.join(single, by)
    hot = F.broadcast(written(hot, "hot"))
    other = [c for c in rows.columns if c not in by]
    dealt = rows.join(hot, by, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*other), F.col("_parts")).cast("int"), F.lit(0))).drop("_parts")
    copied = single.join(hot, by, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts") - 1, F.lit(0))))).drop("_parts")
    return dealt.join(copied, [*by, "_salt"]).drop("_salt")


def _signatures(sets: DataFrame, m: int) -> DataFrame:
    """(cid, sig) of (cid, set): a byte of each place of the signature."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_chunks(iter(batches), "set", 128 << 10):
            found = mixed(superminhash([np.frombuffer(x, np.uint64) for x in batch["set"].to_pylist()], m)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch["cid"], pa.array([x.tobytes() for x in found], pa.binary())], ["cid", "sig"])

    return sets.mapInArrow(tidied(run), "cid long, sig binary")


def _partners(rows: pa.Table, numerator: int, denominator: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(a, others, sizes, root) of each text of a task and those beside it, of other components, that the sizes and signatures leave. Side 0 meets
    side 1, or itself if there is none. The caller may join components in ``root`` meanwhile."""
    side, n, root = np.asarray(rows["side"]), np.asarray(rows["n_shingles"]), np.asarray(rows["component"]).copy()
    sig = np.frombuffer(b"".join(rows["sig"].to_pylist()), np.uint8).reshape(len(n), -1)
    t, m = numerator / denominator, sig.shape[1]
    least = m * t - 6.5 * math.sqrt(m * t * (1 - t))
    right = np.flatnonzero(side == 1)
    for a in np.flatnonzero(side == 0):
        other = right if len(right) else np.arange(a + 1, len(n))
        other = other[(root[other] != root[a]) & (np.minimum(n[other], n[a]) * denominator >= np.maximum(n[other], n[a]) * numerator)]
        other = other[(sig[other] == sig[a]).sum(axis=1) >= least]
        if len(other):
            yield a, other, n, root


def with_partners(rows: pa.Table, numerator: int, denominator: int) -> np.ndarray:
    """Which texts of a task have a partner near the threshold."""
    out = np.zeros(rows.num_rows, bool)
    for a, other, _, _ in _partners(rows, numerator, denominator):
        out[a] = True
        out[other] = True
    return out


def linked_in_cells(rows: pa.Table, numerator: int, denominator: int) -> tuple[list[int], list[int]]:
    """Links between the texts of two cells (side 0 and 1) or within one (all on side 0) that join different components."""
    ids = rows["cid"].to_pylist()
    sets = [np.frombuffer(x, np.uint64) for x in rows["set"].to_pylist()]
    out: tuple[list[int], list[int]] = ([], [])
    for a, other, n, root in _partners(rows, numerator, denominator):
        flat = np.concatenate([sets[b] for b in other])
        found = sets[a][np.minimum(np.searchsorted(sets[a], flat), n[a] - 1)] == flat
        common = np.add.reduceat(found.astype(np.int64), np.cumsum(n[other]) - n[other])
        for b in other[common * denominator >= (n[a] + n[other] - common) * numerator]:
            out[0].append(ids[a])
            out[1].append(ids[b])
            root[root == root[b]] = root[a]
    return out


def dealt_in_cells(members: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """(family, key, one, two, side, cid, n_shingles, component): each text of ``members`` (family, key, cid, n_shingles, component; a row
    for each open bucket of a text) in the tasks (family, key, one, two) where it meets others; key is 0 in a family compared as a whole."""
    texts = written(members.drop("key").distinct(), "texts")
    cells_of = lambda n: F.ceil(F.col(n) / CELL)
    whole = texts.groupBy("family").agg(F.count("*").alias("n")).select("family", (F.col("n") * cells_of("n")).alias("as_one"), (F.col("n") > CELL).alias("large"))
    split = members.groupBy("family", "key").agg(F.count("*").alias("n")).groupBy("family").agg(F.sum(F.col("n") * cells_of("n")).alias("by_key"))
    ways = written(whole.join(split, "family").select("family", "large", (F.col("large") & (F.col("by_key") < F.col("as_one"))).alias("split")), "ways")
    as_one = meeting(texts, ways.where("not split").drop("split"), "family").withColumn("key", F.lit(0).cast("long"))
    by_key = meeting(members, ways.where("split").drop("split"), "family")
    # texts whose sizes allow a link are in the same or in neighbouring size classes
    step = -math.log(numerator / denominator)
    size = F.when(F.col("large"), F.floor(F.log("n_shingles") / step)).otherwise(0).cast("int")
    sized = written(as_one.unionByName(by_key).withColumn("size", size).drop("large"), "units")
    subs = F.greatest(F.ceil(F.count("*") / CELL), F.ceil(F.sum("n_shingles") * 8 / CELL_BYTES)).cast("int")
    cells = written(sized.groupBy("family", "key", "size").agg(subs.alias("subs")), "cells")
    near = cells.select("family", "key", F.col("size").alias("near"), F.col("subs").alias("near_subs"))
    return (
        meeting(sized, cells, ["family", "key", "size"])
        .withColumn("sub", F.pmod(F.hash("cid"), "subs"))
        .withColumn("near", F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1)))
        .join(near, ["family", "key", "near"])  # rows of one cell and its neighbours: no more than the tasks below
        .withColumn("near_sub", F.explode(F.sequence(F.lit(0), F.col("near_subs") - 1)))
        .withColumn("own", F.struct("size", "sub"))
        .withColumn("other", F.struct(F.col("near").alias("size"), F.col("near_sub").alias("sub")))
        .withColumn("side", (F.col("own") > F.col("other")).cast("int"))
        .select("family", "key", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "side", "cid", "n_shingles", "component")
    )


def linked_in_families(docs: DataFrame, classes: DataFrame, members: DataFrame, numerator: int, denominator: int, m: int, width: int) -> DataFrame:
    """Links (a, b) within families; ``members`` has family, key, cid, n_shingles and component, a row for each text and bucket."""
    ids = members.select("cid").distinct()
    sets = written(_sets_of(docs, written(classes.select("cid", "doc_id", "print").join(ids, "cid"), "ids"), width), "sets")
    signatures = written(_signatures(sets, m), "signatures")
    task = ["family", "key", "one", "two"]
    dealt = written(dealt_in_cells(members, numerator, denominator), "dealt")

    def chosen(table: pa.Table) -> pa.Table:
        return table.filter(pa.array(with_partners(table, numerator, denominator)))

    def linked(table: pa.Table) -> pa.Table:
        a, b = linked_in_cells(table, numerator, denominator)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    rows = dealt.join(signatures, "cid").select(*dealt.columns, "sig")
    near = written(rows.groupBy(*task).applyInArrow(chosen, rows.schema), "near")
    return near.join(sets, "cid").groupBy(*task).applyInArrow(linked, "a long, b long")


def _forest(links: DataFrame) -> DataFrame:
    """Per task, its links reduced to (node, smallest node of its tree) by union-find."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def flushed() -> pa.RecordBatch:
            found = [(x, find(x)) for x in parent]
            found = [f for f in found if f[0] != f[1]]
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        for batch in batches:
            for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True):
                a, b = find(parent.setdefault(a, a) if a not in parent else a), find(parent.setdefault(b, b) if b not in parent else b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            if len(parent) > 1 << 20:
                yield flushed()
                parent.clear()
        if parent:
            yield flushed()

    return links.select("a", "b").mapInArrow(tidied(run), "a long, b long")


def _thinned(forest: DataFrame) -> DataFrame:
    """The same components by links (a, b), b < a: each node keeps its smallest b, and its other ones are linked with that."""
    own = forest.groupBy("a").agg(F.collect_set("b").alias("bs"))  # one from each task that saw the node, at most
    least = F.array_min("bs")
    pairs = F.transform("bs", lambda b: F.when(b == least, F.struct(F.col("a"), b.alias("b"))).otherwise(F.struct(b.alias("a"), least.alias("b"))))
    return own.select(F.explode(pairs).alias("p")).select("p.a", "p.b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of the nodes in ``links`` (a, b), the component being its smallest node.

    Each round gives a node the least label among its own, its neighbours', and those labels' own labels; long chains halve
    in every round. A star of any size is no hot task: see ``meeting``.
    """
    forest = written(_thinned(_thinned(written(_forest(links), "links"))), "forest")
    edges = written(forest.union(forest.select("b", "a")).distinct().toDF("node", "other"), "edges")
    large = edges.limit(HOT + 1).count() > HOT  # fewer rows have no hot key
    join = meeting if large else lambda rows, single, key, counts=None: rows.join(single, key)
    labels = written(edges.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("label")), "labels")
    degrees = written(edges.groupBy("other").agg(F.count("*").alias("members")).where(F.col("members") > HOT), "degrees") if large else None
    while True:
        seen = labels.select(F.col("node").alias("other"), F.col("label").alias("seen"))
        near = join(edges, seen, "other", degrees).groupBy("node").agg(F.min("seen").alias("seen"))
        # hooks: a label's own node takes the least label that any of its followers sees
        step = written(labels.join(near, "node").select("node", "label", F.least("label", "seen").alias("next")), "step")
        hooks = step.groupBy("label").agg(F.min("next").alias("hook"))
        mids = join(step, hooks, "label").select("node", F.col("label").alias("old"), F.least("next", "hook").alias("mid"))
        mids = written(mids, "mids")
        jump = mids.select(F.col("node").alias("mid"), F.col("mid").alias("far"))  # every label is a node
        labels = written(join(mids, jump, "mid").select("node", "old", F.least("mid", "far").alias("label")), "labels")
        changed = not labels.where(F.col("label") < F.col("old")).isEmpty()
        labels = labels.select("node", "label")
        if not changed:
            return labels.select("node", F.col("label").alias("component"))


def near_duplicates(docs: DataFrame, numerator: int = 8, denominator: int = 10, width: int = WIDTH, most_missed: float = MOST_MISSED, with_hash: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (doc_id, text); linked if J >= numerator / denominator.

    ``with_hash`` adds text_hash, Spark's xxhash64 of the text, which tells rows of one doc_id apart.
    """
    rows, bands = bands_for(numerator / denominator, most_missed)
    prints = written(signed(docs, rows, bands, width), "signed")
    own = prints.where(F.col("print").isNotNull() & F.col("doc_id").isNotNull())
    classes = own.groupBy("print").agg(F.min(F.struct("doc_id", "n_shingles", "bands")).alias("r")).select("print", "r.*")
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")

    keyed = classes.select("cid", "n_shingles", F.explode("bands").alias("key"))
    sizes = written(keyed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"), "sizes")
    members = written(meeting(keyed, sizes, "key", sizes), "members")
    shared = members.groupBy("cid").agg(F.sum("members").alias("shared"))
    ranked = members.select("key", "cid", "n_shingles").join(shared, "cid")
    hubs = ranked.groupBy("key").agg(F.max(F.struct("shared", -F.col("cid"), "cid", "n_shingles")).alias("hub"))
    hubs = hubs.select("key", F.col("hub.cid").alias("hub"), F.col("hub.n_shingles").alias("hub_n"))

    def sized(a: str, b: str):
        return F.least(a, b) * denominator >= F.greatest(a, b) * numerator

    stars = meeting(members, hubs, "key", sizes).where((F.col("cid") != F.col("hub")) & sized("n_shingles", "hub_n"))
    stars = written(stars.select(F.col("hub").alias("a"), F.col("cid").alias("b")).distinct(), "stars")
    links = written(confirmed(docs, stars, classes, numerator, denominator, width), "links")
    found = components(links)

    named = members.select("key", "cid", "n_shingles").join(found.withColumnRenamed("node", "cid"), "cid", "left")
    named = named.withColumn("component", F.coalesce("component", "cid"))
    mixed_up = named.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most")
    open_ = written(meeting(named, mixed_up.select("key"), "key", sizes), "open")
    if not open_.isEmpty():
        first = open_.groupBy("key").agg(F.min("cid").alias("b"))
        families = components(meeting(open_, first, "key", sizes).where("cid <> b").select(F.col("cid").alias("a"), "b"))
        texts = written(open_.join(families.select(F.col("node").alias("cid"), F.col("component").alias("family")), "cid"), "families")
        more = written(linked_in_families(docs, classes, texts, numerator, denominator, rows * bands, width), "more")
        if not more.isEmpty():
            found = components(links.union(more))

    reached = classes.select("print", "doc_id", "cid").join(found.withColumnRenamed("node", "cid"), "cid", "left").select("print", "doc_id", F.coalesce("component", "cid").alias("component"))
    reached = written(reached, "reached")
    least = reached.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = meeting(reached.select("print", "component"), least, "component").select("print", "component_id")
    copies = own.groupBy("print").agg(F.count("*").alias("members"))
    known = F.col("print").isNotNull() & F.col("doc_id").isNotNull()
    by_print = meeting(prints.where(known).select("doc_id", "text_hash", "n_shingles", "print"), named, "print", copies)
    alone = prints.where(~known).select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id"))
    every = by_print.select(alone.columns).unionByName(alone)
    every = every.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    return every if with_hash else every.drop("text_hash")
