"""Toxicity by class-conditional Kneser-Ney models (operator 9).

Two models spell words: of toxic and of ordinary documents. An expression is a character n-gram inside a word, of order 6 at most
(the history before a word is blank), so that stems with new endings are told too. At order 6 a model has the counts of its class, below
it the class's continuation counts (before how many different characters its expressions stand), and each order backs off
to the shared model of that order, built from the two classes together, interpolated with absolute discounting down to a uniform
one. With the class counts c,

    p_class(x | h) = max(c(h x) - D, 0) / c(h) + D * kinds(h) / c(h) * p_shared(x | h)

where D is estimated from the expressions seen once and twice. A rare expression takes its probability from the shared counts
in both models and so says little. One that neither class has seen leaves both models for the longest shorter one that was
seen; that step has one weight, of the shared counts, for both, so it drops out of the comparison and the class with less data gains nothing by it.

Scoring compares the two log-likelihoods normalised by length, as their difference per character: over the whole text, and over its ``PART`` most toxic
words (by difference over the square root of their length). A logistic curve turns these two and the text's length, with which the largest of
many words grows, into a score from 0 to 1. It is fitted on a fold of the training rows, by counts that leave this fold out; the
final counts come from every training row.

Tasks count, Spark sums by expression, and every expression keeps its own counts, so the model grows with the input. Up to a counted
number of expressions the probabilities are worked out in numpy and every task holds them; beyond it they are Spark
aggregates by history (at most 1024 rows each), and the texts' distinct expressions, in chunks of a few MB, are joined with them.

Defined results: null and empty texts, texts without letters, and all texts when one class has no rows to learn from, get the share of toxic
training rows (0 without any); several labels of a document count as their largest; words of equal weight are taken in the order
of the text; characters from U+0300 on share 256 symbols; a very long text is worked on in pieces that end at white space, beside which 16 bytes a
word are held; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ledgerlens.llm.common import in_chunks, labelled, mixed, tidied, written
from ledgerlens.llm.langid import folded, pieces

ORDER = 6
#: Expressions that the driver and every task hold at once, at most; more of them are joined.
MOST_BROADCAST = 1_000_000
#: Bytes of text in one chunk where expressions are joined, about; one text at least.
CHUNK = 2 << 20
#: Rows for the logistic curve, at most.
MOST_CALIBRATED = 40_000
_WIDTH = 10  # bits of a character
_TAG = 60  # bits of a code; the order stands above them
#: Words that the part of the text with the largest difference has, at most.
PART = 5
FEATURES = "f0 double, f1 double, f2 double"


def spelled(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """The code of the n-gram that ends at each character, word by word with the blank after it; where each word begins."""
    x = folded(text) if text else None
    if x is None:
        return None
    symbols = np.where(x == 32, 0, np.where(x < 768, x, 768 + x % 256))
    blanks = np.flatnonzero(symbols == 0)
    since = np.arange(len(x))
    since[1:] -= np.repeat(blanks[:-1], np.diff(blanks))  # a blank ends the word before it
    codes = symbols.copy()
    for k in range(1, ORDER):
        before = np.zeros_like(symbols)
        before[k:] = symbols[:-k]
        codes |= np.where(since > k, before, 0) << (_WIDTH * k)
    return codes[1:], blanks[:-1]


def spellings(text: str | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``spelled`` of the pieces of a text; none without a letter."""
    return filter(None, map(spelled, pieces(text or "")))


def tagged(codes: np.ndarray, order: int) -> np.ndarray:
    """The codes of the last ``order`` characters, apart from those of other orders."""
    return (codes & ((1 << (_WIDTH * order)) - 1)) | (order << _TAG)


class Ratios:
    """Log-likelihood ratios by exact tagged code, in an open table at most half full."""

    def __init__(self, codes: np.ndarray, ratios: np.ndarray):
        self.codes, self.ratios = codes.astype(np.int64), ratios.astype(np.float32)
        self.bits = max(1, (2 * len(codes)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.float32)
        left, own, at = self.codes, self.ratios, self._first(self.codes)
        while len(left):
            free = self.keys[at] == -1
            self.keys[at[free]] = left[free]
            there = self.keys[at] == left
            self.values[at[there]] = own[there]
            left, own, at = left[~there], own[~there], self._next(at[~there])

    def __reduce__(self):
        return Ratios, (self.codes, self.ratios)

    def _first(self, codes: np.ndarray) -> np.ndarray:
        return (mixed(codes.astype(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _next(self, at: np.ndarray) -> np.ndarray:
        return (at + 1) & ((1 << self.bits) - 1)

    def found(self, tagged_codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ratio of each code, and whether it is there."""
        at = self._first(tagged_codes)
        seen = self.keys[at]
        out, there = self.values[at].astype(np.float64), seen == tagged_codes
        open_ = np.flatnonzero(~there & (seen != -1))
        at = at[open_]
        while len(open_):
            at = self._next(at)
            seen = self.keys[at]
            hit = seen == tagged_codes[open_]
            out[open_[hit]], there[open_[hit]] = self.values[at[hit]], True
            more = ~hit & (seen != -1)
            open_, at = open_[more], at[more]
        return out, there

    def of(self, codes: np.ndarray) -> np.ndarray:
        """The ratio of each n-gram, or of the longest of its ends that is there; 0 if none is."""
        out, left = np.zeros(len(codes)), np.arange(len(codes))
        for k in range(ORDER, 0, -1):
            own, there = self.found(tagged(codes[left], k))
            out[left[there]] = own[there]
            left = left[~there]
            if not len(left):
                break
        return out


def counted(rows: DataFrame) -> DataFrame:
    """(code, toxic, ordinary): how often each expression occurs in the rows (text, toxic) of each class."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list] = ([], [])
        size = 0

        def flushed() -> pa.RecordBatch:
            own = [np.unique(np.concatenate(h), return_counts=True) if h else (np.zeros(0, np.int64), np.zeros(0, np.int64)) for h in held]
            codes = np.union1d(own[0][0], own[1][0])
            sums = np.zeros((2, len(codes)), np.int64)
            for k, (c, n) in enumerate(own):
                sums[k, np.searchsorted(codes, c)] = n
            for h in held:
                h.clear()
            return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(sums[1]), pa.array(sums[0])], ["code", "toxic", "ordinary"])

        for batch in in_chunks(iter(batches), "text", 1 << 20):
            for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), strict=True):
                for codes, _ in spellings(text):
                    held[toxic].append(codes)
                    size += len(codes)
                    if size > 4 << 20:
                        yield flushed()
                        size = 0
        yield flushed()

    parts = rows.select("text", "toxic").mapInArrow(tidied(run), "code long, toxic long, ordinary long")
    return parts.groupBy("code").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def _by_history(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every n-gram: the sum of its history's counts, and the number of its different continuations."""
    _, at = np.unique(codes >> _WIDTH, return_inverse=True)
    return np.bincount(at, counts)[at], np.bincount(at, counts > 0)[at]


def _discount(counts: np.ndarray) -> float:
    return _discount_from((counts == 1).sum(), (counts == 2).sum())


def _discount_from(once: int, twice: int) -> float:
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5


def shared_levels(codes: np.ndarray, counts: np.ndarray, order: int = ORDER) -> list[tuple[np.ndarray, np.ndarray]]:
    """(codes, interpolated Kneser-Ney probabilities) of the n-grams of orders 1 to ``order``, from the counts of both classes."""
    levels = [(codes, counts)]
    for k in range(order - 1, 0, -1):  # continuation counts: distinct (k + 1)-grams by their last k characters
        levels.append(np.unique(levels[-1][0] & ((1 << (_WIDTH * k)) - 1), return_counts=True))
    out = [(np.zeros(1, np.int64), np.full(1, 1.0 / max(len(levels[-1][0]), 1)))]
    for k, (c, n) in enumerate(reversed(levels), 1):
        totals, kinds = _by_history(c, n)
        d = _discount(n)
        shorter, lower = out[-1]
        at = np.searchsorted(shorter, c & ((1 << (_WIDTH * (k - 1))) - 1))
        out.append((c, np.maximum(n - d, 0) / totals + d * kinds / totals * lower[at]))
    return out[1:]


def shared_probabilities(codes: np.ndarray, counts: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The probabilities of the n-grams of full order."""
    return shared_levels(codes, counts, order)[-1][1]


def class_ratios(codes: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray) -> Ratios:
    """The log of each n-gram's probability in the toxic class over that in the other, for every order; none where a class has no counts."""
    order = np.argsort(codes)
    codes, counts = codes[order], np.stack([toxic[order], ordinary[order]])
    if not len(codes) or not counts.sum(axis=1).all():
        return Ratios(codes[:0], np.zeros(0))
    shared = shared_levels(codes, counts.sum(axis=0))
    all_codes, all_ratios = [], []
    for k in range(ORDER, 0, -1):
        if k < ORDER:
            shorter, at = np.unique(codes & ((1 << (_WIDTH * k)) - 1), return_inverse=True)
            codes, counts = shorter, np.stack([np.bincount(at, own > 0).astype(np.int64) for own in counts])
        logs = []
        for own in counts:
            totals, kinds = _by_history(codes, own)
            d = _discount(own)
            seen = np.maximum(totals, 1)
            p = shared[k - 1][1]
            logs.append(np.log(np.where(totals > 0, np.maximum(own - d, 0) / seen + d * kinds / seen * p, p)))
        all_codes.append(tagged(codes, k))
        all_ratios.append(logs[0] - logs[1])
    return Ratios(np.concatenate(all_codes), np.concatenate(all_ratios))


def class_ratio_table(counts: DataFrame) -> DataFrame:
    """(code, ratio) of (code, toxic, ordinary): what ``class_ratios`` finds, as Spark aggregates; no history has more than 1024 rows."""
    suffix = lambda k: F.col("code").bitwiseAND((1 << (_WIDTH * k)) - 1)
    by_history = Window.partitionBy(F.shiftright("code", _WIDTH))
    levels = [counts.select("code", "toxic", "ordinary", (F.col("toxic") + F.col("ordinary")).alias("n"))]
    for k in range(ORDER - 1, 0, -1):  # continuation counts of the classes and of both together
        kinds = [F.count_if(F.col(c) > 0).alias(c) for c in ("toxic", "ordinary")]
        levels.append(written(levels[-1].groupBy(suffix(k).alias("code")).agg(*kinds, F.count("*").alias("n")), f"order{k}"))
    shared = counts.sparkSession.createDataFrame([(0, 1.0 / max(levels[-1].count(), 1))], "suffix long, lower double")
    out: DataFrame | None = None
    for k, level in enumerate(reversed(levels), 1):
        ones = [F.count_if(F.col(c) == i).alias(f"{c}{i}") for c in ("n", "toxic", "ordinary") for i in (1, 2)]
        r = level.agg(*ones).first()
        d = {c: _discount_from(r[f"{c}1"], r[f"{c}2"]) for c in ("n", "toxic", "ordinary")}
        total = F.sum("n").over(by_history)
        own = level.withColumn("suffix", suffix(k - 1)).withColumn("own", F.greatest(F.col("n") - d["n"], F.lit(0.0)) / total).withColumn("rest", d["n"] * F.count("*").over(by_history) / total)
        level = written(own.join(shared, "suffix").select("code", "toxic", "ordinary", (F.col("own") + F.col("rest") * F.col("lower")).alias("p")), f"shared{k}")
        shared = level.select(F.col("code").alias("suffix"), F.col("p").alias("lower"))

        def log(name: str, d: dict[str, float] = d) -> Column:
            own, total = F.col(name), F.sum(name).over(by_history)
            seen = F.greatest(own - d[name], F.lit(0.0)) / total + d[name] * F.count_if(own > 0).over(by_history) / total * F.col("p")
            return F.log(F.when(total > 0, seen).otherwise(F.col("p")))

        ratios = level.select(F.col("code").bitwiseOR(F.lit(k << _TAG)).alias("code"), (log("toxic") - log("ordinary")).cast("float").alias("ratio"))
        out = ratios if out is None else out.unionByName(ratios)
    return written(out, "ratios")


def features(text: str | None, ratios: Ratios) -> tuple[float, float, float] | None:
    """Difference of the log-likelihoods per character over the text, and over its most toxic words; log of the number of words. None without a letter."""
    parts = []
    for codes, starts in spellings(text):
        own = ratios.of(codes)
        parts.append((np.add.reduceat(own, starts), np.diff(np.append(starts, len(own)))))
    if not parts:
        return None
    words, lengths = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    part = np.argsort(-words / np.sqrt(lengths), kind="stable")[:PART]
    return float(words.sum() / lengths.sum()), float(words[part].sum() / lengths[part].sum()), float(np.log(len(words)))


class ToxicityModel:
    """Log-likelihood ratios, held or as a table (code, ratio), the logistic curve, and the share of toxic training rows."""

    def __init__(self, ratios: Ratios | None, table: DataFrame | None = None):
        self.ratios, self.table = ratios, table
        self.weights, self.share, self.learned = np.zeros(4), 0.0, False
        self.offset, self.scale = np.zeros(3), np.ones(3)

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        """Logistic regression by Newton steps with a small ridge; a difference of likelihoods never lowers the score: one that would has weight 0."""
        self.offset, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
        z = np.column_stack([np.ones(len(x)), (x - self.offset) / self.scale])
        free = np.ones(z.shape[1], bool)
        while True:
            w = np.zeros(free.sum())
            ridge = np.diag([1e-6, *[1e-2] * (len(w) - 1)])
            own = z[:, free]
            for _ in range(50):
                p = 1 / (1 + np.exp(-np.clip(own @ w, -30, 30)))
                step = np.linalg.solve(own.T @ (own * (p * (1 - p))[:, None]) + ridge, own.T @ (y - p) - ridge @ w)
                w += step
                if np.abs(step).max() < 1e-9:
                    break
            self.weights, self.learned = np.zeros(len(free)), True
            self.weights[free] = w
            lowering = self.weights < 0
            lowering[[0, 3]] = False  # the constant and the length
            if not lowering.any():
                return
            free &= ~lowering

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Scores of rows of features; the share where they are missing, or nothing was learned."""
        z = np.column_stack([np.ones(len(x)), (x - self.offset) / self.scale])
        found = 1 / (1 + np.exp(-np.clip(z @ self.weights, -30, 30)))
        return np.where(np.isnan(x).any(axis=1) | (not self.learned), self.share, found)


def _ratios_of(counts: DataFrame, most_broadcast: int) -> tuple[Ratios | None, DataFrame | None]:
    """The ratios of (code, toxic, ordinary) in one object up to a counted number of rows, as a table beyond it."""
    n, toxic, ordinary = counts.agg(F.count("*"), F.sum("toxic"), F.sum("ordinary")).first()
    if n <= most_broadcast or not toxic or not ordinary:
        few = (counts if toxic and ordinary else counts.limit(0)).toArrow()
        return class_ratios(*(np.asarray(few[c]) for c in ("code", "toxic", "ordinary"))), None
    return None, class_ratio_table(counts)


def learn_toxicity(docs: DataFrame, labels: DataFrame, training: Column, calibration: Column, most_broadcast: int = MOST_BROADCAST, most_calibrated: int = MOST_CALIBRATED) -> ToxicityModel:
    """Learn from all rows of ``labels`` (doc_id, toxic) where ``training`` holds; the curve from those where ``calibration`` holds too, by
    the counts of the others."""
    known = labels.where(training & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    counts = [written(counted(labelled(docs.select("doc_id", "text"), known.where(c))), "expressions") for c in (~calibration, calibration)]
    others = ToxicityModel(*_ratios_of(counts[0], most_broadcast))
    chosen = known.where(calibration).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_calibrated)  # bounded by the parameter
    found = _mapped(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), others, ["toxic"], FEATURES, lambda x: list(x.T)).toArrow()
    whole = counts[0].unionByName(counts[1]).groupBy("code").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
    model = ToxicityModel(*_ratios_of(written(whole, "expressions"), most_broadcast))
    model.share = known.agg(F.avg("toxic")).first()[0] or 0.0
    x, y = np.column_stack([np.asarray(found[f"f{k}"], np.float64) for k in range(3)]), np.asarray(found["toxic"], np.float64)
    x, y = x[own := ~np.isnan(x).any(axis=1)], y[own]
    if len(y) and 0 < y.sum() < len(y):
        model.fit(x, y)
    return model


def _mapped(rows: DataFrame, model: ToxicityModel, keep: list[str], added: str, finish: Callable[[np.ndarray], list[np.ndarray]]) -> DataFrame:
    """The columns ``keep`` and those that ``finish`` makes of the features of each whole text."""
    schema, names = rows.select(keep).schema, []
    for field in added.split(", "):
        schema, names = schema.add(*field.split(" ")), [*names, field.split(" ")[0]]
    rows = rows.select(*dict.fromkeys([*keep, "text"]))

    def columns(texts: Iterable[str | None], ratios: Ratios) -> list[pa.Array]:
        x = np.array([features(t, ratios) or (np.nan,) * 3 for t in texts], np.float64).reshape(-1, 3)
        return [pa.array(c) for c in finish(x)]

    if model.table is None:
        shared = rows.sparkSession.sparkContext.broadcast(model.ratios)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in in_chunks(iter(batches), "text", 4 << 20):
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), *columns(batch["text"].to_pylist(), shared.value)], [*keep, *names])

        return rows.mapInArrow(tidied(run), schema)

    def dealt(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 33
        for batch in in_chunks(iter(batches), "text", CHUNK):
            yield batch.append_column("_chunk", pa.array(np.full(batch.num_rows, chunk)))
            chunk += 1

    def spelt(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_chunks(iter(batches), "text", CHUNK):
            chunks = np.asarray(batch["_chunk"])
            for c in np.unique(chunks):
                texts = batch["text"].filter(pa.array(chunks == c)).to_pylist()
                codes = np.unique(np.concatenate([np.zeros(0, np.int64), *(np.unique(f[0]) for t in texts for f in spellings(t))]))
                for k in range(ORDER, 0, -1):
                    own = np.unique(tagged(codes, k))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), c)), pa.array(own)], ["_chunk", "code"])

    def scored(texts: pa.Table, known: pa.Table) -> pa.Table:
        ratios = Ratios(known["code"].to_numpy(), known["ratio"].to_numpy())
        return pa.Table.from_arrays([*(texts[c] for c in keep), *columns(texts["text"].to_pylist(), ratios)], [*keep, *names])

    held = written(rows.mapInArrow(tidied(dealt), StructType([*rows.schema, StructField("_chunk", LongType())])), "chunks")  # no text changes its chunk
    known = held.select("_chunk", "text").mapInArrow(tidied(spelt), "_chunk long, code long").join(model.table, "code")
    return held.groupBy("_chunk").cogroup(known.groupBy("_chunk")).applyInArrow(scored, schema)


def score_toxicity(docs: DataFrame, model: ToxicityModel, keep: list[str]) -> DataFrame:
    """``score`` of each whole text beside the columns ``keep``."""
    curve = ToxicityModel(None)
    curve.weights, curve.offset, curve.scale, curve.share, curve.learned = model.weights, model.offset, model.scale, model.share, model.learned
    return _mapped(docs, model, keep, "score double", lambda x: [curve.scores(x)])
