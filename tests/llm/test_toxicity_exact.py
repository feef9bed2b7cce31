"""Toxicity models whose expressions keep their own counts, at any number of them."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import toxicity


def test_every_code_keeps_its_ratio():
    rng = np.random.default_rng(5)
    codes = np.unique(rng.integers(0, 1 << 60, 50_000))
    ratios = rng.normal(size=len(codes)).astype(np.float32)
    table = toxicity.Ratios(codes, ratios)
    found, there = table.found(codes)
    assert np.array_equal(found, ratios.astype(np.float64)) and there.all()
    others = np.setdiff1d(rng.integers(0, 1 << 60, 50_000), codes)
    assert not table.found(others)[1].any() and not toxicity.Ratios(codes[:0], ratios[:0]).of(others).any()


class PlainModel:
    """Both class models by their definition, n-gram by n-gram; blanks are zeros."""

    def __init__(self, toxic, ordinary):
        count = lambda texts: Counter(g for t in texts for g in plain_grams(t))
        self.own = {6: [count(toxic), count(ordinary)]}
        self.both = {6: self.own[6][0] + self.own[6][1]}
        for k in range(5, 0, -1):
            self.own[k] = [Counter(g[1:] for g in c) for c in self.own[k + 1]]
            self.both[k] = Counter(g[1:] for g in self.both[k + 1])

    @staticmethod
    def discounted(table, gram):
        """Discounted share of the gram, and the weight left for shorter ones; None for a history without counts."""
        own = {g: n for g, n in table.items() if g[:-1] == gram[:-1]}
        if not own:
            return None
        values = np.array(list(table.values()))
        d = toxicity._discount(values)
        return max(table.get(gram, 0) - d, 0) / sum(own.values()), d * len(own) / sum(own.values())

    def shared(self, gram):
        if not gram:
            return 1 / len(self.both[1])
        share, rest = self.discounted(self.both[len(gram)], gram)
        return share + rest * self.shared(gram[1:])

    def ratio(self, gram):
        """Of the longest end of the gram that was seen."""
        while gram and gram not in self.both[len(gram)]:
            gram = gram[1:]
        if not gram:
            return 0.0
        p = self.shared(gram)
        logs = [math.log(p if (f := self.discounted(c, gram)) is None else f[0] + f[1] * p) for c in self.own[len(gram)]]
        return logs[0] - logs[1]

    def features(self, text):
        words = [[self.ratio(g) for g in plain_grams(w)] for w in text.split()]
        every = [x for w in words for x in w]
        part = sorted(words, key=lambda w: -sum(w) / math.sqrt(len(w)))[: toxicity.PART]
        return sum(every) / len(every), sum(map(sum, part)) / sum(map(len, part)), math.log(len(words))


def plain_grams(text):
    """Six characters up to each character of each word and the blank after it."""
    return [s[i - 5 : i + 1] for w in text.split() for s in ["\0" * 5 + w + "\0"] for i in range(5, len(s))]


def test_ratios_features_and_scores_by_brute_force(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randrange(1, 7)))
    texts = [" ".join([word() for _ in range(8)] + ["xab" + word()] * (i % 3 == 0)) for i in range(40)]
    toxic, ordinary = texts[:30:3], [t for i, t in enumerate(texts[:30]) if i % 3]
    plain = PlainModel(toxic, ordinary)
    rows = spark.createDataFrame([(t, int(t in toxic)) for t in texts[:30]], "text string, toxic int")
    few = toxicity.counted(rows).toArrow()
    ratios = toxicity.class_ratios(*(np.asarray(few[c]) for c in ("code", "toxic", "ordinary")))
    for t in texts:  # the last ten have expressions that no class has seen
        assert np.allclose(ratios.of(toxicity.spelled(t)[0]), [plain.ratio(g) for g in plain_grams(t)], atol=1e-5)
        assert np.allclose(toxicity.features(t, ratios), plain.features(t), atol=1e-5)
    model = toxicity.ToxicityModel(ratios)
    x = np.array([plain.features(t) for t in texts])
    model.fit(x, np.array([float("xab" in t) for t in texts]))
    model.share = 0.25
    found = toxicity.score_toxicity(spark.createDataFrame([*enumerate([*texts, None, "", " 12 "])], "doc_id long, text string"), model, ["doc_id"])
    z = (x - model.offset) / model.scale @ model.weights[1:] + model.weights[0]
    want = [*(1 / (1 + np.exp(-z))), 0.25, 0.25, 0.25]
    assert np.allclose([r.score for r in found.orderBy("doc_id").collect()], want, atol=1e-4)


def test_the_likelihoods_decide(spark):
    """Both differences raise the score, and that of the toxic words has the largest weight."""
    d, m = (spark.read.parquet(f"/root/testdata/sf0.01/{x}.parquet") for x in ("documents", "labels"))
    model = toxicity.learn_toxicity(d, m, F.lit(True), F.crc32(F.col("doc_id").cast("string")) % 5 == 1)
    w = model.weights[1:]
    assert w[0] >= 0 and w[1] == np.abs(w).max()
    assert abs(model.share - m.where("toxic is not null").agg(F.avg("toxic")).first()[0]) < 1e-12


@pytest.fixture(scope="module")
def labelled_texts(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnopé") for _ in range(rng.randrange(1, 9)))
    rows = [(i, None if i == 7 else "" if i == 8 else " ".join([word() for _ in range(40)] + ["grob" + word()] * (i % 4 == 0))) for i in range(300)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(240)], "doc_id long, toxic int")


def test_ratios_as_aggregates(spark, labelled_texts):
    """The table that Spark makes has the ratios that numpy finds, one for every code that occurs."""
    d, m = labelled_texts
    counts = toxicity.counted(d.join(m, "doc_id")).cache()
    all_codes = {c for r in d.join(m, "doc_id").collect() if (f := toxicity.spelled(r.text)) for k in range(1, 7) for c in toxicity.tagged(f[0], k).tolist()}
    few = counts.toArrow()
    want = toxicity.class_ratios(*(np.asarray(few[c]) for c in ("code", "toxic", "ordinary")))
    found = {r.code: r.ratio for r in toxicity.class_ratio_table(counts).collect()}
    assert set(found) == set(want.codes.tolist()) == all_codes
    assert np.allclose([found[c] for c in want.codes.tolist()], want.ratios, atol=1e-5)


def test_joined_scores_are_the_held_ones(spark, labelled_texts, monkeypatch):
    monkeypatch.setattr(toxicity, "CHUNK", 2000)
    d, m = labelled_texts
    d = d.unionByName(d.where("doc_id < 3"))  # repeated rows stay repeated
    scores = []
    for most in (10**9, 10):
        model = toxicity.learn_toxicity(d, m, F.lit(True), F.col("doc_id") % 5 == 1, most_broadcast=most)
        assert (model.table is None) == (most > 10)
        scores.append(sorted((r.doc_id, r.score) for r in toxicity.score_toxicity(d, model, ["doc_id"]).collect()))
    assert [x[0] for x in scores[0]] == [x[0] for x in scores[1]] and len(scores[0]) == 303
    assert np.allclose([x[1] for x in scores[0]], [x[1] for x in scores[1]], atol=1e-5)


@pytest.mark.parametrize("most", [10**6, 10])
def test_the_fold_of_the_curve_is_counted(spark, labelled_texts, most):
    d, m = labelled_texts
    model = toxicity.learn_toxicity(d, m, F.lit(True), F.col("doc_id") % 5 == 1, most_broadcast=most)
    occurring = {c for r in d.join(m, "doc_id").collect() if (f := toxicity.spelled(r.text)) for k in range(1, 7) for c in toxicity.tagged(f[0], k).tolist()}
    assert (set(model.ratios.codes.tolist()) if model.table is None else {r.code for r in model.table.collect()}) == occurring
