"""Ranked search, spelling variants and the quality classifier against brute force, and on awkward rows."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import AWKWARD, DOCS, awkward, clashing, empty, rows

from shelfwise.llm import quality_model, ranking, spelling
from shelfwise.llm.queries import QUERIES

ITEMS = "item_id long, text string"
LABELS = "doc_id long, quality int, toxic int"


# ---- ranked search ----------------------------------------------------------
def _terms(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", low)


def _ranking_brute(docs, items, k=10):
    counted = [(d, Counter(_terms(t))) for d, t in docs]
    held = [(d, c) for d, c in counted if c]
    n_docs, occurrences = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    wanted = defaultdict(Counter)
    for i, t in items:
        wanted[i].update(_terms(t))
    out = []
    for i, terms in wanted.items():
        found = []
        for d, c in held:
            m = 25 + 75 * sum(c.values()) * n_docs // occurrences
            s = sum(x * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, x in terms.items() if t in c)
            if s > 0:
                found.append((-s, d is None, d or 0, d))
        out += [(i, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(found, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def _some_texts(rng, n, words):
    vocabulary = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 3))) for _ in range(60)]
    return [rng.choice([" ", "-", ", ", "\n"]).join(rng.choice([str.upper, str.title, str])(rng.choice(vocabulary)) for _ in range(rng.randint(0, words))) for _ in range(n)]


@pytest.mark.parametrize("round_pairs", [ranking.ROUND_PAIRS, 40])
def test_ranking_matches_brute_force(spark, round_pairs, monkeypatch):
    rng = random.Random(51)
    texts = _some_texts(rng, 300, 40)
    # copies make ties, also at the tenth place; ids in no order, some repeated, some null
    docs = [(rng.choice([None, rng.randint(-5, 400)]), t) for t in texts + texts[:40] * 4] + [(999, None), (998, "")]
    items = [(i % 17, t) for i, t in enumerate(_some_texts(rng, 20, 12))] + [(None, "ab abc"), (77, None), (78, "..."), (79, texts[0])]
    monkeypatch.setattr(ranking, "DOC_TILE", 32)
    monkeypatch.setattr(ranking, "ITEM_TILE", 5)
    got = ranking.rank_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, ITEMS), round_pairs=round_pairs)
    assert sorted((tuple(r) for r in got.collect()), key=str) == _ranking_brute(docs, items)


def test_vocabulary_tiles_stay_exact():
    # weights so large that a tile of all terms would pass 2^53
    g = np.random.default_rng(52)
    item = np.sort(g.integers(0, 7, 400))
    term = np.concatenate([g.permutation(120)[: (item == i).sum()] for i in range(7)])
    weight = g.integers(1, 2**31, 400)
    at = [np.sort(g.permutation(120)[:50]).astype(np.int32) for _ in range(20)]
    tf = [g.integers(1, 9, 50).astype(np.int32) for _ in at]
    factor = g.integers(25, 300, 20)
    cut = list(ranking.tiles(item, term, weight.astype(float), 3))
    assert len(cut) > 3
    for _, _, dense in cut:
        assert (dense.sum(axis=0) * ranking.IMPACT_LIMIT < ranking.EXACT).all() or len(dense) == 1
    got = {int(i): s[:, j].tolist() for items, s in ranking.tile_scores(at, tf, factor, iter(cut), 120) for j, i in enumerate(items)}
    for i in range(7):
        wanted = {int(t): int(w) for t, w in zip(term[item == i], weight[item == i])}
        for d in range(20):
            assert got[i][d] == sum(wanted.get(int(t), 0) * (10**9 * int(f) // (1000 * int(f) + 8 * int(factor[d]))) for t, f in zip(at[d], tf[d]))


def test_ranking_awkward(spark):
    items = spark.createDataFrame([(1, "Cat HOUSE w5x", 3, "x"), (1, None, 4, "y")], ITEMS + ", score long, TEXT string")
    got = ranking.rank_documents(clashing(spark), items)
    assert [(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got.orderBy("rank").collect()] == sorted(_ranking_brute([(r[0], r[1]) for r in AWKWARD], [(1, "Cat HOUSE w5x")]), key=lambda x: x[1])
    assert ranking.rank_documents(empty(spark), items).count() == 0
    assert ranking.rank_documents(awkward(spark), spark.createDataFrame([], ITEMS)).count() == 0
    assert got.columns == ["item_id", "rank", "doc_id", "score"]


# ---- spelling variants ------------------------------------------------------
def _words_brute(docs):
    n = Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def _one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _spelling_brute(docs):
    n = _words_brute(docs)
    near = {w: [x for x in n if _one_edit(w, x)] for w in n}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


def _spelling_corpus(rng, stems, n, length):
    alphabet = "abÀéz"
    words = ["".join(rng.choice(alphabet) for _ in range(rng.randint(7, length))) for _ in range(stems)]
    # chains of ever rarer variants, and words that only differ at their ends
    for w in words[: stems // 2]:
        i = rng.randrange(len(w))
        words += [w[:i] + w[i + 1 :] + "x", w[:i] + rng.choice(alphabet) + w[i + 1 :], w + "q", "q" + w, w[1:], w[:-1]]
    weights = [rng.choice([1, 1, 2, 30, 400]) for _ in words]
    pick = lambda k: rng.choices(words, weights, k=k)
    return [(rng.choice([None, rng.randint(0, 10**6)]), rng.choice([" ", "1", "-"]).join(f(w) for w in pick(rng.randint(0, 60)) for f in [rng.choice([str, str.title])])) for _ in range(n)]


@pytest.mark.parametrize("longest", [spelling.LONGEST, 9])
def test_spelling_matches_brute_force(spark, longest, monkeypatch):
    # with a small limit most words take the rest of their path in one step
    monkeypatch.setattr(spelling, "LONGEST", longest)
    docs = _spelling_corpus(random.Random(53), 60, 150, 12)
    docs += [(i, w) for i, w in enumerate(["chainabx"] * 3 + ["chainacx"] * 40 + ["chainaczx"] * 600)]
    got = spelling.spelling_variants(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    want = _spelling_brute(docs)
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[0]) == want
    assert any(r[1] not in (None, r[2]) for r in want) and len({len(r[0]) for r in want}) > 4


def test_long_words_are_neighbours(spark):
    junk = "ab" * 2500
    words = [junk, junk[:-1], junk[:2000] + "z" + junk[2000:], junk[:99] + "q" + junk[100:], "x" * 40, "x" * 41, "x" * 39, "x" * 39 + "y"]
    docs = [(i, " ".join(words)) for i in range(3)] + [(7, words[4])] * 40
    got = rows(spelling.spelling_variants(spark.createDataFrame(docs, "doc_id long, text string")), "word", "form", "root", "n", "n_near", "form_n")
    assert got == _spelling_brute(docs)


def test_spelling_awkward(spark):
    got = rows(spelling.spelling_variants(clashing(spark)), "word", "form", "root", "n", "n_near", "form_n")
    assert got == _spelling_brute([(r[0], r[1]) for r in AWKWARD])
    assert spelling.spelling_variants(empty(spark)).count() == 0
    few = spark.createDataFrame([(1, "wordone wordone wordtwo")], "doc_id long, text string")
    assert [r["word"] for r in spelling.spelling_variants(few).collect()] == [x[0] for x in _spelling_brute([(1, "wordone wordone wordtwo")])]


# ---- quality classifier -----------------------------------------------------
def _prose(rng, n):
    return " ".join(rng.choice(["the", "of", "and", "house", "river", "walks", "Green", "quiet", "morning"]) for _ in range(n)) + "."


def _junk(rng, n):
    kind = rng.randrange(3)
    if kind == 0:
        return " | ".join(rng.choice(["click", "here", "buy", "99"]) for _ in range(n))
    return " ".join([rng.choice(["spam", "spam", "the"])] * n) if kind == 1 else _prose(rng, n).upper().replace(" ", "!! ")


def _labelled(n, seed):
    rng = random.Random(seed)
    kinds = [rng.random() < 0.7 for _ in range(n)]
    docs = [(i, (_prose if good else _junk)(rng, rng.randint(20, 80)), "en", "s", 0) for i, good in enumerate(kinds)]
    return docs, [(i, int(good), 0) for i, good in enumerate(kinds)]


def _out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_classifier_on_held_out_rows(spark):
    docs, labels = _labelled(900, 54)
    # held-out labels are wrong on purpose: nothing may be learned from them
    taught = [(i, 1 - q if _out(i) else q, t) for i, q, t in labels]
    got = quality_model.quality_scores(spark.createDataFrame(docs, DOCS), spark.createDataFrame(taught, LABELS)).collect()
    assert len(got) == 900 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert all(r["held_out"] == _out(r["doc_id"]) for r in got)
    held = [r for r in got if r["held_out"]]
    assert len(held) > 150 and sum(r["predicted"] == labels[r["doc_id"]][1] for r in held) >= 0.97 * len(held)


def test_classifier_awkward(spark):
    docs, labels = _labelled(300, 55)
    many = spark.createDataFrame([(r[0] and r[0] + 10**6, *r[1:]) for r in AWKWARD if r[0] != 2**62] + docs, DOCS)
    odd = [(None, 1, 0), (5, 0, 0), (5, 1, 0), (6, None, 0), (7, 9, 0), (10**9, 1, 0)] + [x for x in labels if x[0] > 7]
    got = quality_model.quality_scores(many, spark.createDataFrame(odd, LABELS))
    assert got.count() == len(AWKWARD) - 1 + 300 and got.where("score IS NULL OR held_out IS NULL").count() == 0
    by = {r["doc_id"]: r["score"] for r in got.collect()}
    assert by[10**6 + 2] == by[10**6 + 3]  # null like empty
    for none in ([], [(1, 1, 0)]):
        same = quality_model.quality_scores(clashing(spark), spark.createDataFrame(none, LABELS))
        assert {r["score"] for r in same.collect()} == {1.0 if none and not _out(1) else 0.5} and same.count() == len(AWKWARD)
    assert quality_model.quality_scores(empty(spark), spark.createDataFrame(odd, LABELS)).count() == 0
    assert quality_model.quality_scores(many.selectExpr("*", "1 AS score", "2 AS TEXT"), spark.createDataFrame(odd, LABELS)).columns == ["doc_id", "held_out", "score", "predicted"]


def test_context_vectors_match_a_plain_count(spark):
    texts = ["a b c a, b", "b b 12\nc", ""]
    words = ["a", "b", "c", ",", "\n", *quality_model.SHAPES, *quality_model.MARKERS]
    got = quality_model.context_vectors(spark.createDataFrame([(t,) for t in texts], "text string"), words)
    index = quality_model.index_vectors(words)
    want = np.zeros((len(words), quality_model.DIMENSIONS))
    for t in texts:
        ids = [words.index(x if x in words else quality_model.shape(x)) for x in quality_model.TOKEN.findall(t)]
        for i, w in enumerate(ids):
            for j in range(max(0, i - quality_model.WINDOW), min(len(ids), i + quality_model.WINDOW + 1)):
                if j != i:
                    want[w] += index[ids[j]]
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-12)
    assert np.allclose(got, want) and np.abs(want).sum() > 0


def test_pooled_features_match_plain_means():
    words = ["the", "cat", *quality_model.SHAPES, *quality_model.MARKERS]
    context = np.random.default_rng(56).normal(size=(len(words), quality_model.DIMENSIONS)).astype(np.float32)
    pooling, index = quality_model.Pooling(words, context), quality_model.index_vectors(words)
    text = "The cat THE cat cat Zebra!! 12"
    names = ["the", "<title>", "cat", "the", "<upper>", "cat", "cat", "<again>", quality_model.shape("Zebra"), "<title>", "<marks>", "<number>"]
    ids = [words.index(x) for x in names]
    row = pooling.features([text])[0]
    d = quality_model.DIMENSIONS
    assert np.allclose(row[:d], context[ids].mean(axis=0), atol=1e-5) and np.allclose(row[d : 2 * d], context[ids].std(axis=0), atol=1e-4)
    assert np.allclose(row[2 * d : 3 * d], index[ids].mean(axis=0), atol=1e-5) and row[-1] == pytest.approx(math.log1p(len(ids)))
    assert not pooling.features([None, ""]).any()


def test_network_learns_and_calibrates():
    g = np.random.default_rng(57)
    x = g.normal(size=(1500, 4))
    y = (g.random(1500) < 1 / (1 + np.exp(-3 * x[:, 0] * x[:, 1]))).astype(float)
    net = quality_model.train(x[:1000], y[:1000])
    quality_model.calibrate(net, x[1000:], y[1000:])
    p = net.scores(x[1000:])
    loss = -np.log(np.where(y[1000:] > 0, p, 1 - p)).mean()
    assert loss < 0.55  # a coin has 0.69
    assert np.allclose(quality_model.network_of(net.arrays()).scores(x), net.scores(x))


def test_queries_cover_their_tables(spark, sf_small):
    documents = spark.read.parquet(f"{sf_small}/documents.parquet")
    items = spark.read.parquet(f"{sf_small}/benchmark.parquet")
    docs = [(r["doc_id"], r["text"]) for r in documents.collect()]
    got = QUERIES["op11_ranked_search"](spark, sf_small).collect()
    assert sorted((tuple(r) for r in got), key=str) == _ranking_brute(docs, [tuple(r) for r in items.select("item_id", "text").collect()])
    assert rows(QUERIES["op13_quality_classifier"](spark, sf_small), "doc_id") == rows(documents, "doc_id")
