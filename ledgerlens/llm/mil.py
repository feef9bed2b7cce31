"""Document quality by attention-based multiple-instance learning (operator 7).

A document is a bag of passages of ``PASSAGE`` words. Every passage of every text is described by numbers from its bytes and
words (shares of character classes, hashed byte pairs, word lengths, and how much of it is repeated in the document), encoded by a
tanh layer, and given a gated attention weight,

    a_k = softmax_k( w . (tanh(V h_k) * sigmoid(U h_k)) ),

learned from the documents' labels alone. The weighted sum of the encodings is the document's, and a logistic unit scores it.

The network is trained on the driver with Adam from a bounded sample of the labelled training rows (``most_documents``, those with the
smallest hash of doc_id, and of them those that fit into ``most_passages``), which is all it may learn from; the passages of all documents are
encoded and scored in the tasks.

Defined results: null and empty texts are a bag of one passage of zeros; several labels of a document count as their smallest; rows that
repeat a labelled id are learned from as often; without both labels in the sample every score is the share of label 1 (0.5 without labels);
of equally heavy passages the first is named; a very long text is hashed in pieces and costs some 10 bytes a character and 256 bytes a
passage; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import hashed_words, in_chunks, mixed, ragged, shingle_hashes, tidied, utf8, written
from ledgerlens.llm.mixing import words

PASSAGE = 50
MOST_DOCUMENTS = 6000
#: Passages that the driver learns from, at most: 256 bytes each as they come, 512 while it learns.
MOST_PASSAGES = 200_000
#: Classes of bytes: lower, upper, digit, sentence marks, symbols, other ASCII marks, line ends, blanks, control, beyond ASCII.
_CLASSES = 10
_PAIRS = 48
WIDTH = _CLASSES + _PAIRS + 6
_HIDDEN, _GATES = 32, 16


def _classes() -> np.ndarray:
    out = np.full(256, 8, np.int64)
    out[33:127] = 5
    for chars, k in ((b"abcdefghijklmnopqrstuvwxyz", 0), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"0123456789", 2), (b".,;:!?'\"()-", 3), (b"#*$%&|<>", 4), (b"\n\r", 6), (b" \t\v\f", 7)):
        out[list(chars)] = k
    out[128:] = 9
    return out


_CLASS_OF = _classes()


def passages(items: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Descriptions of all passages of all texts, and the number of passages before each text and, last, in all."""
    words, starts, first = hashed_words(items)
    data = np.frombuffer(b"\n".join(items) + b"\n", np.uint8)
    n_words = np.diff(first)
    bags = np.maximum(1, -(-n_words // PASSAGE))
    before = np.concatenate(([0], np.cumsum(bags)))
    n = int(before[-1])
    text_starts = np.cumsum([0, *(len(x) + 1 for x in items)])
    # the passage of each word, and of each byte: that of the last word begun, or the text's first
    word_text = np.repeat(np.arange(len(items)), n_words)
    word_passage = before[word_text] + (np.arange(len(words)) - first[word_text]) // PASSAGE
    step = np.zeros(len(data), np.int64)
    marks = np.concatenate((text_starts[:-1], starts))
    values = np.concatenate((before[:-1], word_passage))
    step[marks] = values
    byte_passage = np.maximum.accumulate(step)
    out = np.zeros((n, WIDTH), np.float32)
    out[:, :_CLASSES] = np.bincount(byte_passage * _CLASSES + _CLASS_OF[data], minlength=n * _CLASSES).reshape(n, _CLASSES)
    sizes = np.maximum(out[:, :_CLASSES].sum(axis=1), 1)
    pairs = (mixed(data[:-1].astype(np.uint64) << np.uint64(8) | data[1:]) >> np.uint64(40)).astype(np.int64) % _PAIRS
    within = np.ones(len(pairs), bool)
    within[text_starts[1:-1] - 1] = False  # not over the end of a text
    out[:, _CLASSES : _CLASSES + _PAIRS] = np.bincount((byte_passage[:-1] * _PAIRS + pairs)[within], minlength=n * _PAIRS).reshape(n, _PAIRS)
    out[:, : _CLASSES + _PAIRS] /= sizes[:, None]
    out[:, _CLASSES : _CLASSES + _PAIRS] *= 4
    counts = np.bincount(word_passage, minlength=n)
    out[:, -6] = np.log1p(counts) / 4
    out[:, -5] = np.where(counts > 0, sizes / np.maximum(counts, 1), 0) / 16
    repeated = np.zeros(len(words), np.float32)
    if len(words) >= 5:
        windows = shingle_hashes(words)
        inside = word_text[: len(windows)] == word_text[4:]
        key = mixed(windows + mixed(word_text[: len(windows)].astype(np.uint64)))
        _, at, times = np.unique(key, return_inverse=True, return_counts=True)
        hit = np.concatenate(((times[at] > 1) & inside, np.zeros(4, bool)))
        for k in range(5):
            repeated[k:] = np.maximum(repeated[k:], hit[: len(hit) - k])
    same = np.zeros(len(words), np.float32)
    same[1:] = (words[1:] == words[:-1]) & (word_text[1:] == word_text[:-1])
    for k, x in ((-4, repeated), (-3, same)):
        out[:, k] = np.bincount(word_passage, x, minlength=n) / np.maximum(counts, 1)
    out[:, -2] = counts == 0
    out[:, -1] = np.repeat(np.minimum(bags, 64) / 64, bags)
    return out, before


class AttentionModel:
    """Gated attention over encoded passages; float64 weights."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        init = lambda a, b: rng.normal(0, 1 / np.sqrt(a), (a, b))
        self.w = {"W": init(WIDTH, _HIDDEN), "s": np.zeros(_HIDDEN), "V": init(_HIDDEN, _GATES), "U": init(_HIDDEN, _GATES), "g": init(_GATES, 1)[:, 0], "c": init(_HIDDEN, 1)[:, 0], "b": np.zeros(1)}
        self.mean, self.scale = np.zeros(WIDTH), np.ones(WIDTH)

    def forward(self, x: np.ndarray, starts: np.ndarray) -> tuple:
        w, sizes = self.w, np.diff(np.append(starts, len(x)))
        h = np.tanh((x - self.mean) / self.scale @ w["W"] + w["s"])
        t, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-np.clip(h @ w["U"], -30, 30)))
        e = (t * g) @ w["g"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
        a = e / np.repeat(np.add.reduceat(e, starts), sizes)
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return h, t, g, a, z, 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["b"], -30, 30))), sizes

    def scores(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return self.forward(x, starts)[5]

    def attention(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The weight of each passage in its document."""
        return self.forward(x, starts)[3]

    def _gradients(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w = self.w
        h, t, g, a, z, p, sizes = self.forward(x, starts)
        d = (p - y) / len(y)
        dz = np.repeat(d[:, None] * w["c"], sizes, axis=0)
        da = (h * dz).sum(axis=1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, starts), sizes))
        dtg = de[:, None] * w["g"]
        dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
        dh = (a[:, None] * dz + dt @ w["V"].T + dg @ w["U"].T) * (1 - h * h)
        return {"W": ((x - self.mean) / self.scale).T @ dh, "s": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "g": (t * g).T @ de, "c": z.T @ d, "b": np.array([d.sum()])}

    def fit(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray, epochs: int = 30, batch: int = 128, rate: float = 0.004, decay: float = 1e-4, seed: int = 11) -> None:
        """Adam on the cross-entropy of document labels; the rate falls to zero over the epochs."""
        self.mean, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
        rng, ends = np.random.default_rng(seed), np.append(starts[1:], len(x))
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(u) for k, u in self.w.items()}
        steps, step = epochs * -(-len(y) // batch), 0
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for own in np.array_split(order, -(-len(y) // batch)):
                rows = np.concatenate([np.arange(starts[i], ends[i]) for i in own])
                sizes = ends[own] - starts[own]
                grads = self._gradients(x[rows], np.cumsum(sizes) - sizes, y[own])
                step += 1
                for k, u in grads.items():
                    u = u + decay * self.w[k]
                    m[k] = 0.9 * m[k] + 0.1 * u
                    v[k] = 0.999 * v[k] + 0.001 * u * u
                    self.w[k] = self.w[k] - rate * (1 - step / steps) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)


def learn_quality(docs: DataFrame, labels: DataFrame, training: Column, most_documents: int = MOST_DOCUMENTS, most_passages: int = MOST_PASSAGES) -> AttentionModel:
    """Learn from at most ``most_documents`` rows of ``labels`` (doc_id, quality) where ``training`` holds."""
    known = labels.where(training & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_documents)

    def describe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_chunks(iter(batches), "text", 1 << 20):
            x, before = passages(utf8(batch["text"]))
            rows = [x[a:b].ravel() for a, b in zip(before[:-1], before[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["quality"], ragged(rows, pa.float32())], ["doc_id", "quality", "x"])

    texts = written(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "sample")
    bags = F.greatest(F.lit(1), F.ceil(words() / PASSAGE)).cast("long")
    sizes = texts.groupBy("doc_id").agg(F.sum(bags).alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()  # at most most_documents rows
    fitting, left = [], most_passages
    for r in sizes:
        if r.n <= left:
            fitting.append((r.doc_id,))
            left -= r.n
    texts = texts.join(F.broadcast(docs.sparkSession.createDataFrame(fitting, "doc_id long")), "doc_id")
    found = texts.select("doc_id", "quality", "text").mapInArrow(tidied(describe), "doc_id long, quality int, x array<float>").toArrow()
    found = found.sort_by("doc_id").combine_chunks()
    model = AttentionModel()
    y = np.asarray(found["quality"], np.float64)
    if len(y) and 0 < y.sum() < len(y):
        lengths = np.asarray(pa.compute.list_value_length(found["x"])) // WIDTH
        flat = np.asarray(found["x"].combine_chunks().flatten(), np.float64).reshape(-1, WIDTH)
        model.fit(flat, np.cumsum(lengths) - lengths, y)
    else:
        model.w["c"][:] = 0
        share = np.clip(y.mean() if len(y) else 0.5, 1e-9, 1 - 1e-9)
        model.w["b"][0] = np.log(share / (1 - share))
    return model


def score_quality(docs: DataFrame, model: AttentionModel, keep: list[str]) -> DataFrame:
    """``score`` of each whole text, and the place of its heaviest passage with its weight, beside the columns ``keep``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    new = ["score", "top_passage", "top_weight"]
    schema = docs.select(keep).schema.add("score", "double").add("top_passage", "integer").add("top_weight", "double")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_chunks(iter(batches), "text", 1 << 20):
            x, before = passages(utf8(batch["text"]))
            _, _, _, a, _, p, sizes = shared.value.forward(x, before[:-1])
            top = np.maximum.reduceat(a, before[:-1])
            hits = np.flatnonzero(a == np.repeat(top, sizes))
            at = hits[np.searchsorted(hits, before[:-1])] - before[:-1]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.array(p), pa.array(at.astype(np.int32)), pa.array(top)], [*keep, *new])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(tidied(run), schema)
