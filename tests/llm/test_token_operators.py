"""Token files, packing, neighbours, sharding, mixing and the pipeline."""

import collections
import itertools
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from brute import base_counts, empty_table, near_duplicate_groups, odd_rows, odd_table
from conftest import SF
from ledgerlens.llm import ann, hilbert, mixing, packing, queries, token_codes
from ledgerlens.llm.tokens import END_ID, WordEncoder

TOKENIZER = queries.tokenizer_file()


@pytest.fixture(scope="module")
def whole():
    """Ids of whole texts by the tokenizer itself."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, END_ID]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


_ENCODER = WordEncoder(TOKENIZER, cache_bytes=100_000)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.text(alphabet="abÀéß'sreİıΣς .,!\n\t\x0b\x1c\x85\xa0<|endoftext|>0̸́", max_size=40)), max_size=5))
def test_words_give_the_ids_of_whole_texts(texts):
    items = [t.encode("utf-8", "ignore") for t in texts]
    assert _ENCODER.encode(items) == _ENCODER.raw(items)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 255), st.integers(0, 70_000), st.integers(0, 2**32 - 1)), max_size=1500))
def test_codes_roundtrip_and_access(ids):
    codes = token_codes.encode_codes(np.array(ids, np.uint32))
    assert token_codes.decode_codes(codes).tolist() == ids
    for i in range(0, len(ids), 1 + len(ids) // 40):
        assert token_codes.access(codes, i) == ids[i]


def test_bad_codes():
    with pytest.raises(ValueError, match="not a segment"):
        token_codes.decode_codes(b"nothing")


def test_token_files(spark, tmp_path, whole, monkeypatch):
    monkeypatch.setattr(token_codes, "SEGMENT_TOKENS", 2000)
    table = odd_table(spark)
    path = str(tmp_path / "t")
    token_codes.write_token_files(table, path, TOKENIZER, shards=5)
    found = token_codes.read_token_files(spark, path).orderBy("start").collect()
    ids = [np.frombuffer(r.ids, "<u4").tolist() for r in found]
    key = lambda x: (-1 if x is None else x)
    assert [key(r.doc_id) for r in found] == sorted(key(r[0]) for r in odd_rows())
    assert [r.start for r in found] == [sum(map(len, ids[:i])) for i in range(len(ids))] and [r.n_tokens for r in found] == list(map(len, ids))
    want = collections.Counter((r[0], tuple(whole(r[1]))) for r in odd_rows())
    assert collections.Counter((r.doc_id, tuple(x)) for r, x in zip(found, ids, strict=True)) == want
    flat = [x for own in ids for x in own]
    places = [0, 1, 1999, len(flat) // 2, len(flat) - 1]
    assert {r.position: r.id for r in token_codes.tokens_at(spark, path, [*places, len(flat)]).collect()} == {p: flat[p] for p in places}
    plan = token_codes.tokens_at(spark, path, [0, len(flat) // 2])._jdf.queryExecution().toString()
    pushed = plan[plan.index("PushedFilters") :].split("]")[0]
    assert all(f"EqualTo(shard,{k})" in pushed for k in (0,)) and "GreaterThan(stop," in pushed and "LessThanOrEqual(first," in pushed
    token_codes.write_token_files(empty_table(spark), str(tmp_path / "e"), TOKENIZER, shards=3)
    assert token_codes.read_token_files(spark, str(tmp_path / "e")).count() == 0


def test_token_query(spark, whole):
    found = queries.op2_token_codes(spark, SF).orderBy("doc_id").collect()
    rows, at = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect(), 0
    for r, d in zip(found, rows, strict=True):
        ids = whole(d.text)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, at, len(ids), crc(ids))
        at += len(ids)


def test_token_access(spark, whole):
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    flat = [x for r in rows for x in whole(r.text)]
    found = {r.position: r.id for r in queries.token_access(spark, SF).collect()}
    assert found == {p: flat[p] for p in (len(flat) * k // 1000 for k in range(1000))}


# packing


def plain_choice(levels, size, window):
    """The level that makes the sum of squares least, by trying each; a new window only if better; ties to the fullest."""
    squares = lambda n: sum(v * v for k, v in n.items() if 0 < k < window)
    best = None
    for h in sorted((h for h, n in levels.items() if n > 0 and h + size <= window), reverse=True) + [0]:
        after = collections.Counter(levels)
        after[h] -= 1 if h else 0
        after[h + size] += 1
        if best is None or squares(after) < best[0]:
            best = (squares(after), h)
    return best[1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 15), min_size=1, max_size=60))
def test_sum_of_squares_choice(sizes):
    window = 16
    levels, plain = packing.LevelArray(window), collections.Counter()
    for s in sizes:
        own = levels.choose(s)
        assert own == plain_choice(plain, s, window)
        if own:
            levels.take(own)
            plain[own] -= 1
        if own + s < window:
            levels.put(own + s, [])
            plain[own + s] += 1


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 90), max_size=40), st.integers(0, 8))
def test_packed_is_exact(sizes, most_open):
    window, docs, n = 32, [], 0
    for i, s in enumerate(sizes):
        docs.append((i, np.arange(n, n + s, dtype="<u4").tobytes()))
        n += s
    seen, padding = collections.defaultdict(list), 0
    for pieces in packing.packed(docs, window, most_open):
        size = sum(len(p[2]) // 4 for p in pieces)
        assert 0 < size <= window
        padding += 0 if size & (size - 1) == 0 else window - size
        for doc, start, ids, total in pieces:
            assert total == sizes[doc]
            seen[doc].append((start, np.frombuffer(ids, "<u4").tolist()))
    assert padding == 0
    for i, ids in docs:
        own, at = [], 0
        for start, part in sorted(seen[i]):
            assert start == at
            at += len(part)
            own += part
        assert own == np.frombuffer(ids, "<u4").tolist()


def check_packed(found, docs, whole):
    texts = collections.defaultdict(list)
    for d in docs:
        texts[d[0]].append(whole(d[1]))
    sequences = collections.defaultdict(list)
    total = collections.Counter()
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
        total[r.doc_id] += r.length
        assert any(len(ids) == r.doc_tokens and crc(ids[r.start : r.start + r.length]) == r.ids_crc32 for ids in texts[r.doc_id])
    assert total == {k: sum(map(len, v)) for k, v in texts.items()}
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096 and at & (at - 1) == 0  # full, or at a power of two: nothing is padded


def test_packing_query(spark, whole):
    check_packed(queries.op6_packing(spark, SF).collect(), spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect(), whole)


def test_packing_odd_rows(spark, whole):
    pieces = packing.pack_documents(odd_table(spark), TOKENIZER).withColumn("ids_crc32", F.crc32("ids"))
    check_packed(pieces.collect(), odd_rows(), whole)
    assert packing.pack_documents(empty_table(spark), TOKENIZER).count() == 0


# neighbours


def exact(vectors, queries_, k):
    out = {}
    for q, v in vectors.items():
        if queries_(q):
            own = sorted((float(np.sqrt(((v - w) ** 2).sum())), i) for i, w in vectors.items() if i != q)
            out[q] = own[:k]
    return out


def test_recall(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    want = exact({r.vec_id: np.array(r.embedding, float) for r in rows}, lambda i: i % 100 == 0, 10)
    found = collections.defaultdict(list)
    for r in sorted(queries.op5_ivf_pq(spark, "/root/testdata/sf0.1").collect(), key=lambda r: (r.query_id, r["rank"])):
        found[r.query_id].append((r.score, r.vec_id))
        assert len(found[r.query_id]) == r["rank"]
    assert found.keys() == want.keys() and all(len(v) == 10 and v == sorted(v) for v in found.values())
    hits = sum(len({i for _, i in want[q]} & {i for _, i in found[q]}) for q in want)
    assert hits >= 0.9 * 10 * len(want)
    exact_scores = {(q, i): s for q, v in want.items() for s, i in v}
    assert all(abs(exact_scores[q, i] - s) < 1e-12 for q, v in found.items() for s, i in v if (q, i) in exact_scores)


def test_neighbours_odd_vectors(spark):
    good = {i: [float(i % 7), 1.0, float(i)] for i in range(40)} | {i: [1.0, 2.0, 3.0] for i in range(100, 160)}
    bad = [(200, None), (201, []), (202, [0.0, 0.0, 0.0]), (203, [1.0, None, 2.0]), (204, [float("nan"), 1.0, 1.0]), (205, [float("inf"), 1.0, 1.0]), (206, [1.0]), (None, [1.0, 2.0, 3.0])]
    rows = [*good.items(), *bad, (3, good[3])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, score int")
    found = collections.defaultdict(list)
    for r in sorted(ann.nearest_neighbours(df, F.col("vec_id") % 50 == 0, k=10).collect(), key=lambda r: (r.query_id, r["rank"])):
        found[r.query_id].append((r.score, r.vec_id))
    want = exact({i: np.array(v) for i, v in good.items()}, lambda i: i % 50 == 0, 10)
    assert {q: [i for _, i in v] for q, v in found.items()} == {q: [i for _, i in v] for q, v in want.items()}
    few = df.where("vec_id < 4")
    assert {r.query_id: 3 for r in ann.nearest_neighbours(few, F.lit(True)).collect()} == {0: 3, 1: 3, 2: 3, 3: 3}
    assert ann.nearest_neighbours(few, F.lit(True)).count() == 12
    assert ann.nearest_neighbours(df.where("vec_id >= 200"), F.lit(True)).count() == 0
    assert ann.nearest_neighbours(df.where("false"), F.lit(True)).count() == 0
    assert ann.nearest_neighbours(df.where("vec_id = 1"), F.lit(True)).count() == 0


def test_blocks_and_copies(spark, monkeypatch):
    monkeypatch.setattr(ann, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(1)
    rows = [(int(i), rng.normal(size=8).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = ann.nearest_neighbours(df, F.col("vec_id") % 2 == 0, k=5, block=16).collect()
    want = exact({i: np.array(v) for i, v in rows}, lambda i: i % 2 == 0, 5)
    assert len(found) == 1000
    assert sum((r.vec_id in {i for _, i in want[r.query_id]}) for r in found) >= 0.9 * 1000


# sharding


@pytest.mark.parametrize(("n", "bits"), [(2, 1), (2, 4), (3, 3), (4, 2)])
def test_hilbert_curve_is_a_walk(spark, n, bits):
    cells = list(itertools.product(range(1 << bits), repeat=n))
    df = spark.createDataFrame(cells, [f"x{i}" for i in range(n)])
    rows = df.select("*", hilbert.hilbert_index([F.col(f"x{i}") for i in range(n)], bits).alias("h")).orderBy("h").collect()
    assert [r.h for r in rows] == list(range(len(cells)))
    assert all(sum(abs(a - b) for a, b in zip(p[:-1], q[:-1], strict=True)) == 1 for p, q in zip(rows, rows[1:], strict=False))


def check_shards(found, sizes):
    by = collections.defaultdict(list)
    for r in found:
        by[r.shard].append(r.slot)
    counts = [len(by[s]) for s in range(16)]
    assert sum(counts) == len(sizes) and max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in found) == collections.Counter(sizes)


def test_shard_query(spark):
    found = queries.op8_hilbert_shards(spark, SF)
    assert "Python" not in found._jdf.queryExecution().toString()
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    check_shards(found.collect(), [(r.doc_id, len(r.text.encode()) + 1, zlib.crc32(r.text.encode())) for r in rows])
    # runs of the curve: shards do not overlap
    ends = found.groupBy("shard").agg(F.min("curve").alias("a"), F.max("curve").alias("b")).orderBy("shard").collect()
    assert all(p.b <= q.a for p, q in zip(ends, ends[1:], strict=False))


def test_shard_odd_rows(spark, tmp_path):
    odd_table(spark).write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.op8_hilbert_shards(spark, str(tmp_path))
    check_shards(found.collect(), [(r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in odd_rows()])
    assert set(r.law for r in found.collect()) == {"rows"}
    many = spark.range(500).select("id", F.col("id").cast("string").alias("name"))
    assert hilbert.hilbert_sharded(many, ["name", "id"], ["id"], ["id", "shard"], 3, bits=4).groupBy("shard").count().count() == 3
    empty = hilbert.hilbert_sharded(many.where("false"), ["name", "id"], ["id"], ["id"], 3)
    assert empty.count() == 0
    hilbert.write_shards(hilbert.hilbert_sharded(many, ["id"], ["id"], ["id"], 4), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("shard").count().count() == 4


def test_many_values_prune_by_minima_and_maxima(spark):
    """A thousand sources: a shard spans a small part of their order and of the sizes, so most shards can be skipped by either."""
    rng = random.Random(6)
    rows = [(i, f"src{rng.randrange(1000):04d}", rng.randrange(10**6)) for i in range(20_000)]
    df = spark.createDataFrame(rows, "id long, source string, size long")
    found = hilbert.hilbert_sharded(df, ["source", "size"], ["id"], ["id", "source", "size"], 64)
    spans = found.groupBy("shard").agg(F.min("source").alias("a"), F.max("source").alias("b"), F.min("size").alias("c"), F.max("size").alias("d")).collect()
    hit = lambda lo, hi, x: sum(r[lo] <= x <= r[hi] for r in spans)
    assert np.mean([hit("a", "b", f"src{k:04d}") for k in range(0, 1000, 7)]) < 16 and np.mean([hit("c", "d", k) for k in range(0, 10**6, 9999)]) < 16
    cells = {v: c for v, c in df.select("source", hilbert.quantised(df, "source", 6).alias("c")).distinct().collect()}
    ordered = sorted(cells)
    assert [cells[v] for v in ordered] == [k * 64 // len(ordered) for k in range(len(ordered))]


# mixing


def test_water_filling():
    assert mixing.filled(100, [1, 1, 2], [10, 100, 100]) == [10, 30, 60]
    assert mixing.filled(100, [1, 0, 1], [10, 50, 20]) == [10, 0, 20]
    assert mixing.filled(10, [1, 1, 1], [9, 9, 9]) == [4, 3, 3]
    assert mixing.filled(0, [1], [5]) == [0] and mixing.filled(5, [], []) == []


def test_shortage_goes_to_siblings_before_ancestors():
    supply = {("a", "x"): 10, ("a", "y"): 1000, ("b", "x"): 1000}
    assert mixing.budgets(supply, {}, 200) == {("a", "x"): 10, ("a", "y"): 90, ("b", "x"): 100}
    supply[("a", "y")] = 30
    assert mixing.budgets(supply, {}, 200) == {("a", "x"): 10, ("a", "y"): 30, ("b", "x"): 160}
    assert mixing.budgets(supply, {("b",): 0.0}, 200)[("b", "x")] == 0


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.tuples(*[st.sampled_from("abc")] * 3), st.integers(0, 50), min_size=1), st.integers(0, 600), st.dictionaries(st.tuples(*[st.sampled_from("abc")] * 2), st.floats(0, 5)))
def test_budgets_spend_all_they_can(supply, total, weights):
    found = mixing.budgets(supply, weights, total)
    usable = sum(n for leaf, n in supply.items() if weights.get(leaf[:2], 1.0) > 0)
    assert all(0 <= found[k] <= supply[k] for k in supply) and sum(found.values()) == min(total, usable)


def levels():
    return {"domain": F.lit("d"), "language": F.col("lang"), "origin": F.col("source")}


@pytest.mark.parametrize(("share", "epochs"), [(0.5, 1), (1.7, 3), (10.0, 2)])
def test_mixing_by_brute_force(spark, monkeypatch, share, epochs):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 5)
    monkeypatch.setattr(mixing, "SPAN_RANGES", 3)
    rows = [(i, "w " * (1 + i * i % 97), "en" if i % 3 else "de", f"s{i % 4}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)
    found = mixing.mixed_documents(df, levels(), {("d", "en"): 3.0}, ["doc_id"], share=share, epochs=epochs).collect()
    n = {r[0]: len(r[1].split()) for r in rows}
    leaf = {r[0]: ("d", r[2], r[3]) for r in rows}
    supply = collections.Counter()
    for i, own in leaf.items():
        supply[own] += n[i] * epochs
    want = mixing.budgets(supply, {("d", "en"): 3.0}, int(share * sum(n.values())))
    taken = collections.Counter()
    for r in found:
        assert (r.domain, r.language, r.origin) == leaf[r.doc_id] and 0 <= r.take_tokens <= n[r.doc_id] == r.n_tokens
        taken[leaf[r.doc_id]] += r.take_tokens
    assert {k: v for k, v in taken.items() if v} == {k: v for k, v in want.items() if v}
    cut = collections.Counter(leaf[r.doc_id] for r in found if r.take_tokens < r.n_tokens)
    assert all(v == 1 for v in cut.values())  # a prefix: one document a leaf is cut
    assert len({(r.doc_id, r.epoch) for r in found}) == len(found)
    # the epochs can be replayed: each has an order of its own, and the last one is a prefix of it that ends with the document that is cut
    by = collections.defaultdict(list)
    for r in found:
        by[leaf[r.doc_id], r.epoch].append((r.place, r.doc_id, r.take_tokens < r.n_tokens))
    assert all(len({p for p, _, _ in v}) == len(v) and not any(c for _, _, c in sorted(v)[:-1]) for v in by.values())
    orders = {k: [i for _, i, _ in sorted(v)] for k, v in by.items()}
    assert all(orders[k, e] != orders[k, e - 1] for k, e in orders if e and len(orders[k, e]) > 5)
    again = mixing.mixed_documents(df, levels(), {("d", "en"): 3.0}, ["doc_id", "text"], share=share, epochs=epochs).collect()
    key = lambda r: (r.doc_id, r.epoch, r.place, r.take_tokens)
    assert sorted(map(key, again)) == sorted(map(key, found)) and all(len(r.text.split()) == r.n_tokens for r in again)


def test_mixing_odd_rows(spark):
    table = odd_table(spark)
    everything = mixing.mixed_documents(table, levels(), {}, table.columns)
    assert everything.where("text is not null and length(trim(text)) > 0").count() >= table.where("text is not null").count() - 3
    half = mixing.mixed_documents(table, levels(), {}, ["doc_id", "epoch"], share=0.5)
    total = everything.agg(F.sum("take_tokens")).first()[0]
    assert 0.5 * total - 5 <= half.agg(F.sum("take_tokens")).first()[0] <= 0.5 * total
    assert mixing.mixed_documents(empty_table(spark), levels(), {}, ["doc_id"]).count() == 0


# pipeline


def test_pipeline_stages_by_brute_force(spark, whole):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(corpus_pipeline.COLUMNS)
    stage = dict(corpus_pipeline.STAGES)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    a = stage["language ID"](spark, docs, SF)
    assert rows(a) == [r for r in rows(docs) if any(c.isalpha() for c in r[1])]
    b = stage["quality rules"](spark, a, SF)
    passed = {r[0] for r in rows(a) if not ((c := base_counts(r[1]))[0] < 10 or 100 * c[4] > 20 * c[0])}
    assert {r[0] for r in rows(b)} <= passed and len(rows(b)) > 0.8 * len(passed)
    c = stage["near-duplicates"](spark, b, SF)
    groups = near_duplicate_groups([(r[0], r[1]) for r in rows(b)], 8, 10)
    assert rows(c) == [r for r in rows(b) if groups[r[0]][1] == r[0]]
    d = stage["target weights"](spark, c, SF)
    whole_texts, kept = {r[0]: r for r in rows(c)}, rows(d)
    assert len(kept) < len(whole_texts) and len({r[0] for r in kept}) == len(kept)
    n = lambda x: sum(base_counts(r[1])[0] for r in x)
    assert n(kept) == int(0.8 * n(rows(c)))
    cut = [r for r in kept if r != whole_texts[r[0]]]
    assert all(whole_texts[r[0]][1].startswith(r[1]) and r[4] == len(r[1]) and r[2:4] == whole_texts[r[0]][2:4] for r in cut)
    assert len(cut) <= len({(r[2], r[3]) for r in kept})  # one a leaf
    check_packed(stage["packing"](spark, d, SF).collect(), [(r[0], r[1]) for r in rows(d)], whole)
    for df in (a, b, c, d):
        assert df.columns == corpus_pipeline.COLUMNS


def test_pipeline_keeps_one_row_of_each_group(spark):
    w, v = " ".join(f"a{k}" for k in range(100)), " ".join(f"b{k}" for k in range(100))
    rows = [(1, w), (1, w), (2, w), (3, v), (3, w), (4, v + " end"), (None, w)]
    table = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], odd_table(spark).select(corpus_pipeline.COLUMNS).schema)
    found = corpus_pipeline.distinct(spark, table, SF).collect()
    assert sorted(((r.doc_id or 0), r.text) for r in found) == sorted([(0, w), (1, w), (3, v)])


def test_pipeline_rejects_other_languages(spark):
    rng = random.Random(3)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(corpus_pipeline.COLUMNS)
    noise = [(10**6 + i, " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(rng.randrange(2, 9))) for _ in range(80)), "en", "s", 400) for i in range(5)]
    noise.append((10**6 + 5, "Ο γρήγορος σκύλος πηδά πάνω από την τεμπέλικη αλεπού και φεύγει μακριά στο δάσος", None, "s", 80))
    kept = corpus_pipeline.languages(spark, docs.unionByName(spark.createDataFrame(noise, docs.schema)), SF)
    found = {r.doc_id for r in kept.select("doc_id").collect()}
    assert not found & {r[0] for r in noise} and len(found) >= 0.995 * docs.count()


def test_pipeline_runs(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_pipeline_odd_rows(spark, tmp_path):
    odd_table(spark).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    empty_table(spark).write.parquet(str(tmp_path / "e/documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "e")).count() == 0
