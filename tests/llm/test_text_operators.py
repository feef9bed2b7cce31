"""Language ID, quality rules, quality and toxicity models, near-duplicates."""

import collections
import math
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brute import base_counts, empty_table, near_duplicate_groups, odd_rows, odd_table, shingles, words
from conftest import SF
from ledgerlens.llm import common, langid, mil, neardup, queries, quality_rules, toxicity
from ledgerlens.llm.oracle import SQL
from oracle import same


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet").cache()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    same(queries.queries()[name](spark, SF), SQL[name], SF)


# language ID


def plain_profile(texts, top):
    counts = collections.Counter()
    for t in texts:
        s = "".join(c.lower()[0] if c.isalpha() else " " for c in t)
        for w in s.split():
            w = f" {w} "
            for n in (1, 2, 3):
                counts.update(g for g in (w[i : i + n] for i in range(len(w) - n + 1)) if g != " ")
    code = lambda g: sum(ord(c) << (21 * (len(g) - 1 - i)) for i, c in enumerate(g))
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))][:top]


def test_profiles_and_distances_by_brute_force(spark, docs):
    top = 60
    found = langid.learn_profiles(docs, F.col("doc_id") % 3 != 0, top)
    rows = docs.select("doc_id", "text", "lang").collect()
    plain = {lang: plain_profile([r.text for r in rows if r.lang == lang and r.doc_id % 3], top) for lang in sorted({r.lang for r in rows})}
    assert found.languages == list(plain)

    def predict(text):
        own = plain_profile([text], top)
        out = {lang: sum(abs(p.index(g) - k) if g in p else top for k, g in enumerate(own)) for lang, p in plain.items()}
        best = min(out, key=lambda x: (out[x], x))
        return best, 1 - out[best] / (top * len(own))

    for r in rows[:40]:
        lang, score = found.predict(r.text)
        assert (lang, round(score, 9)) == (predict(r.text)[0], round(predict(r.text)[1], 9))


def test_langid_held_out_accuracy(spark, docs):
    found = queries.op1_langid(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.97


def test_langid_odd_rows(spark):
    table = odd_table(spark)
    out = langid.identify(table, langid.learn_profiles(table, F.lit(True)))
    assert out.columns == [c for c in table.columns if c != "score"] + ["lang_pred", "score"]
    rows = out.collect()
    assert len(rows) == table.count() and all(0 <= r.score <= 1 for r in rows)
    for r in rows:
        assert (r.lang_pred == "und") == (r.text is None or not any(c.isalpha() for c in r.text))
    empty = empty_table(spark)
    nothing = langid.learn_profiles(empty, F.lit(True))
    assert langid.identify(empty, nothing).count() == 0 and nothing.predict("abc") == ("und", 0.0)


# quality rules


@pytest.mark.parametrize("source", ["odd", "docs"])
def test_base_counts_by_brute_force(spark, docs, source):
    rows = [(i, r[1], "en") for i, r in enumerate(odd_rows())] if source == "odd" else [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    found = quality_rules.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string"), ["doc_id"]).collect()
    want = {i: base_counts(t) for i, t, _ in rows}
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found} == want


def test_distance_by_brute_force(spark):
    rng = random.Random(4)
    rows = [([rng.randint(0, 9) for _ in range(5)], [rng.randint(0, 9) for _ in range(5)]) for _ in range(50)] + [([0] * 5, [1] * 5), ([1, 0], [0, 1]), ([2, 4], [1, 2])]
    found = spark.createDataFrame(rows, "p array<long>, q array<long>").select("p", "q", quality_rules.distance(F.col("p"), F.col("q")).alias("d")).collect()
    for r in found:
        n, m = sum(r.p), sum(r.q)
        if not n or not m:
            assert r.d == 0
            continue
        part = lambda x, y: x * math.log2(2 * x / (x + y)) if x else 0
        want = math.sqrt(sum(part(a / n, b / m) + part(b / m, a / n) for a, b in zip(r.p, r.q, strict=True)) / 2)
        assert abs(r.d - want) < 1e-9 and -1e-9 <= r.d <= 1 + 1e-9


def test_quality_rules_keep_clean_prose(spark, docs, labels):
    found = quality_rules.judged(docs, ["doc_id"]).join(labels, "doc_id")
    good = found.where("quality = 1 and not base_failed")
    assert good.where("not kept").count() == 0 and found.where("quality = 0 and kept").count() < found.where("quality = 0").count() / 2


def test_quality_rules_odd_rows(spark):
    table = odd_table(spark)
    out = quality_rules.judged(table, table.columns)
    assert out.count() == table.count() and out.columns.count("kept") == 1
    assert all(not r.kept and r.base_failed for r in out.where("n_words < 10").collect())
    assert quality_rules.judged(empty_table(spark), ["doc_id"]).count() == 0


def test_quality_rules_plan_is_native(spark, docs):
    plan = quality_rules.judged(docs, ["doc_id"])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# models


def score_quality_of(spark, found, labels, column):
    rows = found.join(labels, "doc_id").where("held_out").select("score", column).collect()
    pairs = [(a.score, b.score) for a in rows for b in rows if a[1] > b[1]]
    return sum((a > b) + 0.5 * (a == b) for a, b in pairs) / len(pairs)


def test_quality_model_held_out(spark, labels):
    found = queries.op7_quality_mil(spark, "/root/testdata/sf0.01")
    known = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    assert score_quality_of(spark, found, known, "quality") > 0.95


def test_toxicity_model_held_out(spark):
    found = queries.op9_toxicity(spark, "/root/testdata/sf0.01")
    known = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    assert score_quality_of(spark, found, known, "toxic") > 0.85


@pytest.mark.parametrize("which", ["quality", "toxic"])
def test_models_odd_rows(spark, which):
    table = odd_table(spark)
    marks = spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(150)] + [(3, None, None), (3, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    if which == "quality":
        learn = lambda d, m: (mil.score_quality, mil.learn_quality(d, m, F.lit(True)))
    else:
        learn = lambda d, m: (toxicity.score_toxicity, toxicity.learn_toxicity(d, m, F.lit(True), F.coalesce(F.col("doc_id") % 3 == 0, F.lit(False))))
    score, model = learn(table, marks)
    out = score(table, model, ["doc_id", "kept"])
    assert out.count() == table.count() and all(0 <= r.score <= 1 for r in out.collect())
    for marked in (marks.where("false"), marks.where("quality = 1")):
        score, model = learn(table, marked)
        assert all(0 <= r.score <= 1 for r in score(table, model, ["doc_id"]).collect())
    assert score(empty_table(spark), model, ["doc_id"]).count() == 0


def test_attention_gradients():
    rng = np.random.default_rng(0)
    model = mil.AttentionModel()
    x, starts, y = rng.normal(size=(9, mil.WIDTH)), np.array([0, 3, 4]), np.array([1.0, 0.0, 1.0])
    loss = lambda: float(-(y * np.log(p := model.scores(x, starts)) + (1 - y) * np.log(1 - p)).mean())
    grads = model._gradients(x, starts, y)
    for k, w in model.w.items():
        at = tuple(rng.integers(0, s) for s in w.shape)
        w[at] += 1e-6
        up = loss()
        w[at] -= 2e-6
        down = loss()
        w[at] += 1e-6
        assert abs((up - down) / 2e-6 - grads[k][at]) < 1e-6


def test_attention_sums_to_one_and_ignores_order():
    items = [b"a b c " * 200, b"", b"x" * 5000, b"\n".join(b"line %d ###" % i for i in range(300))]
    x, before = mil.passages(items)
    assert len(x) == before[-1] and np.isfinite(x).all()
    assert list(np.diff(before)) == [max(1, -(-len(words(i.decode())) // mil.PASSAGE)) for i in items]
    model = mil.AttentionModel()
    a = model.attention(x, before[:-1])
    assert np.allclose(np.add.reduceat(a, before[:-1]), 1)
    alone, b = mil.passages(items[:1])
    assert np.allclose(model.scores(alone, b[:-1])[0], model.scores(x, before[:-1])[0])


def plain_passages(text):
    """Descriptions of the passages of one text, byte by byte and word by word."""
    data = text + b"\n"
    spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0d]+", data)]
    own = [data[a:b].translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))) for a, b in spans]
    n = max(1, -(-len(own) // 50))
    place = lambda i: max(0, sum(a <= i for a, _ in spans) - 1) // 50
    classes, pairs = np.zeros((n, 10)), np.zeros((n, 48))
    for i, c in enumerate(data):
        x = chr(c)
        kind = 0 if "a" <= x <= "z" else 1 if "A" <= x <= "Z" else 2 if "0" <= x <= "9" else 3 if x in ".,;:!?'\"()-" else 4 if x in "#*$%&|<>" else 6 if x in "\n\r" else 7 if x in " \t\v\f" else 9 if c > 127 else 5 if 33 <= c < 127 else 8
        classes[place(i), kind] += 1
        if i + 1 < len(data):
            pairs[place(i), int(common.mixed(np.array([c << 8 | data[i + 1]], np.uint64))[0] >> np.uint64(40)) % 48] += 1
    sizes = np.maximum(classes.sum(axis=1), 1)
    windows = [tuple(own[i : i + 5]) for i in range(len(own) - 4)]
    twice = {w for w, k in collections.Counter(windows).items() if k > 1}
    covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(5)}
    rows = []
    for k in range(n):
        inside = range(50 * k, min(50 * k + 50, len(own)))
        m = len(inside)
        repeated, same = sum(i in covered for i in inside), sum(i > 0 and own[i] == own[i - 1] for i in inside)
        rows.append([*classes[k] / sizes[k], *4 * pairs[k] / sizes[k], math.log1p(m) / 4, sizes[k] / m / 16 if m else 0, repeated / max(m, 1), same / max(m, 1), m == 0, min(n, 64) / 64])
    return np.array(rows)


def test_passages_and_scores_by_brute_force():
    rng = random.Random(12)
    items = [b"", b" \n", b"One two. THREE 4 five|\tsix", ("é ß; " * 30).encode(), b" ".join(rng.choice([b"a", b"bb", b"Cc,", b"d\n"]) for _ in range(130)), b"x" * 300]
    x, before = mil.passages(items)
    want = [plain_passages(t) for t in items]
    assert np.allclose(x, np.concatenate(want), atol=1e-5) and np.diff(before).tolist() == list(map(len, want))
    model = mil.AttentionModel()
    model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 0.1
    w, sigmoid = model.w, lambda v: 1 / (1 + math.exp(-v))
    scores = []
    for rows in want:
        encoded, weights = [], []
        for row in rows:
            h = [math.tanh(sum((row[i] - model.mean[i]) / model.scale[i] * w["W"][i, j] for i in range(mil.WIDTH)) + w["s"][j]) for j in range(len(w["s"]))]
            gate = lambda m, k, h=h: sum(v * m[i, k] for i, v in enumerate(h))
            weights.append(math.exp(sum(w["g"][k] * math.tanh(gate(w["V"], k)) * sigmoid(gate(w["U"], k)) for k in range(len(w["g"])))))
            encoded.append(h)
        bag = [sum(a * h[j] for a, h in zip(weights, encoded, strict=True)) / sum(weights) for j in range(len(w["s"]))]
        scores.append(sigmoid(sum(b * c for b, c in zip(bag, w["c"], strict=True)) + w["b"][0]))
    assert np.allclose(model.scores(x, before[:-1]), scores, atol=1e-6)


def test_quality_sample_is_bounded_in_passages(spark, docs, labels, monkeypatch):
    seen = []
    monkeypatch.setattr(mil.AttentionModel, "fit", lambda self, x, starts, y: seen.append((len(x), len(y))))
    for most in (10**6, 300):
        mil.learn_quality(docs, labels, F.lit(True), most_passages=most)
    assert seen[0][0] > 300 >= seen[1][0] > 200 and 0 < seen[1][1] < seen[0][1]


def test_kneser_ney_by_brute_force():
    texts = ["banana bandana", "anna ananas", "ban"]
    codes, counts = np.unique(np.concatenate([toxicity.spelled(t)[0] for t in texts]), return_counts=True)
    found = toxicity.shared_probabilities(codes, counts)
    grams = collections.Counter()
    for t in texts:
        for w in t.split():
            s = "\0" * 5 + w + "\0"
            grams.update(s[i - 5 : i + 1] for i in range(5, len(s)))
    assert sorted(grams.values()) == sorted(counts.tolist())
    tables, level = [grams], grams
    for k in range(5, 0, -1):
        level = collections.Counter(g[-k:] for g in level)
        tables.append(level)
    symbols = len({g[-1] for g in grams})

    def p(g):
        if not g:
            return 1 / symbols
        table = tables[6 - len(g)]
        own = [n for x, n in table.items() if x[:-1] == g[:-1]]
        values = np.array(list(table.values()))
        d = toxicity._discount(values)
        return max(table[g] - d, 0) / sum(own) + d * len(own) / sum(own) * p(g[1:])

    code = lambda g: sum((ord(c) if c != "\0" else 0) << (10 * (5 - i)) for i, c in enumerate(g))
    want = {code(g): p(g) for g in grams}
    assert all(abs(want[c] - x) < 1e-12 for c, x in zip(codes.tolist(), found, strict=True))
    # probabilities of one history sum to at most 1
    assert all(sum(p(h + x) for x in {g[-1] for g in grams} if h + x in grams) <= 1 + 1e-9 for h in {g[:-1] for g in grams})


def test_toxic_stems_are_told(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice(["an", "ti", "on", "re", "the"]) for _ in range(3))
    rows, marks = [], []
    for i in range(600):
        own = [word() for _ in range(60)]
        if toxic := int(i % 4 == 0):
            own[rng.randrange(60)] = "grob" + word()
        rows.append((i, " ".join(own)))
        marks.append((i, toxic))
    d, m = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    model = toxicity.learn_toxicity(d, m, F.col("doc_id") < 450, F.col("doc_id") % 5 == 1)
    held = toxicity.score_toxicity(d.where("doc_id >= 450"), model, ["doc_id"]).join(m, "doc_id").collect()
    assert np.mean([(r.score >= 0.5) == bool(r.toxic) for r in held]) > 0.97


# near-duplicates


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aAbB \t\n.é", max_size=40), min_size=1, max_size=6))
def test_shingles_by_brute_force(texts):
    found = neardup.shingle_sets([t.encode() for t in texts])
    assert [len(s) for s in found] == [len(shingles(t)) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            assert len(np.intersect1d(found[i], found[j])) == len(shingles(texts[i]) & shingles(texts[j]))


def plain_superminhash(elements, m):
    """The signature element by element, a whole permutation for each."""
    out = [None] * m
    mask = (1 << 64) - 1
    mix = lambda x: int(common.mixed(np.array([x & mask], np.uint64))[0])
    for e in elements:
        p = list(range(m))
        for j in range(m):
            state = mix(int(e) + (j + 1) * int(neardup._STEP))
            k = j + ((mix(state ^ int(neardup._STEP)) >> 32) * (m - j) >> 32)
            p[j], p[k] = p[k], p[j]
            value = j << 48 | state >> 16
            if out[p[j]] is None or value < out[p[j]]:
                out[p[j]] = value
    return out


@pytest.mark.parametrize("m", [1, 7, 32])
def test_superminhash_by_brute_force(m):
    rng = np.random.default_rng(m)
    sets = [rng.integers(0, 2**63, n).astype(np.uint64) for n in (1, 2, 5, 40, 300)]
    found = neardup.superminhash(sets, m)
    for s, row in zip(sets, found, strict=True):
        assert row.tolist() == plain_superminhash(s, m)


def test_superminhash_estimates_with_lower_variance():
    rng = np.random.default_rng(3)
    m, errors = 64, []
    for _ in range(300):
        x = rng.integers(0, 2**63, 60).astype(np.uint64)
        a, b = x[:45], x[15:]
        s = neardup.superminhash([a, b], m)
        errors.append((s[0] == s[1]).mean() - 0.5)
    assert abs(np.mean(errors)) < 0.02 and np.var(errors) < 0.25 / m


def test_bands():
    for t in (0.8, 0.85, 0.9):
        rows, bands = neardup.bands_for(t)
        assert (1 - t**rows) ** bands <= 1e-8


def edited(rng, w, n):
    w = list(w)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("share", [(85, 100), (8, 10)])
def test_near_duplicates_by_brute_force(spark, share):
    """Families of copies of edited copies, chains, exact copies and a passage that many share."""
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(4000)}"
    rows, passage = [], [word() for _ in range(60)]
    for _ in range(12):
        w = [word() for _ in range(rng.randint(60, 200))]
        rows += [edited(rng, w, rng.randint(0, 5)) for _ in range(25)]
    chain = [word() for _ in range(150)]
    for _ in range(25):
        rows.append(" ".join(chain))
        chain[rng.randrange(150)] = word()
    rows += [" ".join([word() for _ in range(rng.randint(5, 60))] + passage) for _ in range(150)]
    rows += [rows[3]] * 20 + [None, "", " ", "a b", "a b", "A  b", "a c"]
    rng.shuffle(rows)
    table = list(enumerate(rows))
    found = neardup.near_duplicates(spark.createDataFrame(table, "doc_id long, text string").repartition(4), *share).collect()
    want = near_duplicate_groups(table, *share)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def family(n, window=60, step=6):
    """Texts that slide along one sequence: each is like those beside it, and every one is reached from every other."""
    w = [f"w{k}" for k in range(window + n * step)]
    return [" ".join(w[k * step : k * step + window]) for k in range(n)]


@pytest.mark.parametrize("hot", [100_000, 5])
def test_large_family_in_cells(spark, monkeypatch, hot):
    monkeypatch.setattr(neardup, "CELL", 16)
    monkeypatch.setattr(neardup, "HOT", hot)
    rng = random.Random(2)
    w = [f"w{rng.randrange(4000)}" for _ in range(120)]
    texts = [edited(rng, w, rng.randint(1, 4)) for _ in range(120)] + family(80)
    table = list(enumerate(texts))
    found = neardup.near_duplicates(spark.createDataFrame(table, "doc_id long, text string"), 8, 10).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == near_duplicate_groups(table, 8, 10)


def test_rows_into_cells_grow_with_the_family(spark, monkeypatch):
    """Each text shares buckets with a few others, so a family four times as large sends four times the rows."""
    monkeypatch.setattr(neardup, "CELL", 16)

    def dealt(n):
        rows = [(1, b, i, 50, i) for i in range(n) for b in range(i - 4, i + 1)]
        return neardup.dealt_in_cells(spark.createDataFrame(rows, "family long, key long, cid long, n_shingles long, component long"), 8, 10)

    small, large = dealt(200).count(), dealt(800).count()
    assert large <= 4.2 * small and large <= 5 * 800 + 16
    pairs = {(a, b) for g in collect_groups(dealt(100)) for a in g for b in g if 0 < b - a <= 4}
    assert pairs == {(a, b) for a in range(100) for b in range(a + 1, min(a + 5, 100))}


def collect_groups(dealt):
    groups = {}
    for r in dealt.collect():
        groups.setdefault((r.family, r.key, r.one, r.two), []).append(r.cid)
    return groups.values()


def test_rows_of_one_id_are_judged_by_their_own_text(spark):
    w, v = " ".join(f"a{k}" for k in range(100)), " ".join(f"b{k}" for k in range(100))
    rows = [(1, w), (1, w), (2, w), (3, v), (3, w), (4, v + " end")]
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), with_hash=True)
    found = sorted((r.doc_id, r.component_id, r.kept, r.n_shingles) for r in found.collect())
    assert found == [(1, 1, True, 96), (1, 1, True, 96), (2, 1, False, 96), (3, 1, False, 96), (3, 3, True, 96), (4, 3, False, 97)]


def test_long_texts_are_read_in_pieces(monkeypatch):
    """Language ranks, toxic differences and counts are the same whatever the pieces."""
    rng = random.Random(5)
    texts = ["\u2003".join(rng.choice(["abc", "e\u0301te", "Straße", "12", "…"]) * rng.randint(1, 3) for _ in range(200)) for _ in range(3)] + ["12 " * 50 + "x", "y" * 500]
    codes = np.unique(np.concatenate([toxicity.tagged(toxicity.spelled(t)[0], k) for t in texts for k in range(1, 7)]))
    ratios = toxicity.Ratios(codes, np.sin(codes % 1000).astype(np.float32))
    found = lambda: [(langid.ranked(t, 50).tolist(), toxicity.features(t, ratios), sorted(c for f in toxicity.spellings(t) for c in f[0].tolist())) for t in texts]
    whole = found()
    monkeypatch.setattr(langid, "PIECE", 7)
    assert sum(1 for _ in langid.pieces(texts[0])) > 20
    for a, b in zip(whole, found(), strict=True):
        assert a[0] == b[0] and np.allclose(a[1], b[1]) and a[2] == b[2]


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    rng = random.Random(4)
    texts = [" ".join("x" * rng.randint(1, 9) + str(rng.randrange(99)) for _ in range(n)).encode() for n in (0, 1, 7, 3000)] + [b"y" * 5000, b" \n"]
    whole = common.hashed_words(texts)
    monkeypatch.setattr(common, "PIECE", 64)
    assert all((a == b).all() for a, b in zip(whole, common.hashed_words(texts), strict=True))


def test_near_duplicates_odd_rows(spark):
    table = odd_table(spark)
    found = neardup.near_duplicates(table).collect()
    assert len(found) == table.count()
    by = {r.doc_id: r for r in found}
    assert by[9].component_id == 8 and not by[9].kept and by[10].component_id == 8
    assert all(by[i].n_shingles == 0 and by[i].kept for i in (0, 1, 2)) and by[None].component_id is None
    assert neardup.near_duplicates(empty_table(spark)).count() == 0


def test_components_of_a_chain(spark):
    n = 300
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (1001, 1000)], "a long, b long").repartition(7)
    found = {r.node: r.component for r in neardup.components(links).collect()}
    assert found == {i: 0 for i in range(n + 1)} | {1000: 1000, 1001: 1000}
