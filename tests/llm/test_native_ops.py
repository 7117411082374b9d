"""Chat formatting, quality rules, mixing, sharding and packing against brute force, and on awkward rows."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from helpers import AWKWARD, DOCS, awkward, clashing, empty, rows

from shelfwise.llm import chat, mixing, packing, quality, sharding

CHATS = "conv_id long, turn long, role string, text string"


def _chat(spark, convs):
    return spark.createDataFrame([(k, i, r, t) for k, turns in convs.items() for i, (r, t) in enumerate(turns)], CHATS)


def test_chat_keeps_maximal_conversations(spark):
    rng = random.Random(1)
    convs = {}
    for k in range(120):
        base = convs.get(rng.randrange(k)) if k and rng.random() < 0.7 else []
        turns = list(base or [])[: rng.randint(0, 5)] + [(rng.choice("ua"), rng.choice(["x", "y", "", None])) for _ in range(rng.randint(1, 2))]
        convs[k] = turns
    got = {r["conv_id"]: (r["n_turns"], r["n_copies"]) for r in chat.format_chats(_chat(spark, convs)).collect()}
    groups = defaultdict(list)
    for k, t in convs.items():
        groups[tuple(t)].append(k)
    want = {min(ks): (len(t), len(ks)) for t, ks in groups.items() if not any(len(o) > len(t) and o[: len(t)] == t for o in groups)}
    assert got == want


def test_chat_rendering_and_odd_rows(spark):
    df = spark.createDataFrame(
        [(1, 1, "user", "a <|im_end|> b"), (1, 0, "system", None), (2, None, None, "x"), (2, 5, "user", "y"), (None, 0, "user", "z"), (3, 0, "user", "r"), (3, 0, "user", "r")], CHATS
    )
    got = {r["conv_id"]: r["rendered"] for r in chat.format_chats(df).collect()}
    assert got == {
        1: "<|im_start|>system\n<|im_end|>\n<|im_start|>user\na < |im_end|> b<|im_end|>\n",
        2: "<|im_start|>\nx<|im_end|>\n<|im_start|>user\ny<|im_end|>\n",
        3: "<|im_start|>user\nr<|im_end|>\n" * 2,
    }
    assert chat.format_chats(spark.createDataFrame([], CHATS)).count() == 0
    extra = df.selectExpr("*", "1 AS pos", "2 AS h1", "3 AS n_copies", "4 AS TURN")
    assert {r["conv_id"]: r["rendered"] for r in chat.format_chats(extra).collect()} == got


def test_chat_is_native(spark):
    df = chat.format_chats(_chat(spark, {1: [("u", "x")]}))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


def _quality_brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_filter_measures_a_text_once(spark):
    out = quality.quality_filter(clashing(spark))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall("xxhash64", plan)) == 1
    kept = {r["doc_id"] for r in quality.quality_report(awkward(spark)).where("kept").collect()}
    assert {r["doc_id"] for r in out.collect()} == kept and out.columns == clashing(spark).columns
    strict = (quality.Rule("lines", "n_dup_lines", "n_lines", most=0.0), quality.Rule("short", "n_words", most=20))
    want = {r["doc_id"] for r in quality.quality_report(awkward(spark), strict).where("size(failed_rules) = 0").collect()}
    assert {r["doc_id"] for r in quality.quality_filter(awkward(spark), strict).collect()} == want


def test_quality_counts(spark):
    rng = random.Random(2)
    texts = [None, "", "a", "a a a a", "a b c a b c", "x\ny\nx\n\n \n", "a b c\x0bd\x1ce", "\U0001f600 # | <b>", "a b a b a b a"]
    texts += ["".join(rng.choice(["a", "b", "c", " ", " ", "\n", "#", "ü"]) for _ in range(rng.randint(0, 400))) for _ in range(150)]
    texts += [" ".join(rng.choice(["the", "of", "rain", "Spain", "x%"]) for _ in range(rng.randint(40, 90))) for _ in range(30)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    got = quality.quality_report(df).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        n, chars, symbols, dup, rep = _quality_brute(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, rep), t
        assert r["base_failed"] == (n < 50 or 100 * rep > 50 * n)
        assert not (r["kept"] and r["base_failed"])


def test_quality_rules_table(spark):
    good = " ".join(f"the w{i} of" for i in range(40))
    df = spark.createDataFrame([(1, good, "en", "s", 0), (2, good.replace(" ", " # ").strip(), "en", "s", 0)], DOCS)
    assert [r["kept"] for r in quality.quality_report(df).orderBy("doc_id").collect()] == [True, False]
    only = (quality.Rule("n", "n_words", least=1),)
    assert quality.quality_filter(df, only).count() == 2
    assert quality.quality_filter(df, ()).count() == 2


def test_quality_awkward(spark):
    out = quality.quality_filter(clashing(spark))
    assert out.columns == clashing(spark).columns
    assert quality.quality_report(awkward(spark)).count() == len(AWKWARD)
    assert quality.quality_report(empty(spark)).count() == 0
    assert quality.quality_filter(empty(spark)).count() == 0


def test_poisson_inversion():
    for rate in (0.01, 0.7, 3.0, 40.0, 5000.0):
        lo, cdf = mixing.poisson_table(rate)
        mean = sum((lo + i) * (b - a) for i, (a, b) in enumerate(zip([0.0, *cdf], cdf)))
        assert abs(cdf[-1] - 1) < 1e-9 and abs(mean - rate) < 1e-6 * max(1, rate)
    assert mixing.poisson_table(0.0) == (0, [1.0])


def test_mixing_reaches_weights(spark):
    data = [(i, "x" * 100, "en", "big" if i % 10 else "small", 100) for i in range(20_000)]
    out = mixing.mix_sources(spark.createDataFrame(data, DOCS), targets={"big": 1.0, "small": 1.0})
    n = Counter(r["source"] for r in out.select("source").collect())
    assert abs(n["small"] / (n["small"] + n["big"]) - 0.5) < 0.02
    assert abs(sum(n.values()) - 20_000) < 600
    again = mixing.mix_sources(spark.createDataFrame(list(reversed(data)), DOCS), targets={"big": 1.0, "small": 1.0})
    assert rows(out, "doc_id", "copy") == rows(again, "doc_id", "copy")
    # replicas of a document are numbered without gaps
    per = defaultdict(list)
    for r in out.select("doc_id", "copy").collect():
        per[r["doc_id"]].append(r["copy"])
    assert all(sorted(c) == list(range(len(c))) for c in per.values())


def test_mixing_awkward(spark):
    out = mixing.mix_sources(clashing(spark))
    assert out.columns[:-3] == clashing(spark).columns
    assert mixing.mix_sources(empty(spark)).count() == 0
    unnamed = mixing.mix_sources(awkward(spark), targets={})
    assert unnamed.select("rate").distinct().collect()[0][0] == 1.0


def test_sharding(spark):
    rng = random.Random(4)
    data = [(i, rng.choice(["a", "bb", None, "ü" * 9, "same"]), "en", "hot" if rng.random() < 0.6 else rng.choice(["x", "y", None]), 1) for i in range(3001)]
    data += data[:3]
    got = sharding.shard_documents(spark.createDataFrame(data, DOCS), 16).collect()
    sizes = Counter(r["shard"] for r in got)
    assert set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(16):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))
    text = {}
    for d in data:
        text.setdefault(d[0], d[1])
    assert all(r["size"] == len((text[r["doc_id"]] or "").encode()) + 1 and r["text_crc32"] == zlib.crc32((text[r["doc_id"]] or "").encode()) for r in got)
    total = Counter(d[3] for d in data)
    for s in range(16):
        own = Counter(r["source"] for r in got if r["shard"] == s)
        assert all(abs(own[x] - n / 16) <= 2 for x, n in total.items())
    again = sharding.shard_documents(spark.createDataFrame(data[::-1], DOCS).repartition(7), 16)
    assert rows(again, "doc_id", "shard", "slot") == sorted((r["doc_id"], r["shard"], r["slot"]) for r in got)


@pytest.mark.parametrize("kind", ["null ids", "one id", "one row"])
def test_sharding_hot_keys(spark, kind, monkeypatch):
    """A third of all rows without an id, with one id, or equal: no slice of the ranking holds them, places stay gapless."""
    rng = random.Random(8)
    data = [(i if i % 3 else None if kind == "null ids" else 7, "same" if kind == "one row" and i % 3 == 0 else f"t{i}", "en", rng.choice("ab"), 1) for i in range(6000)]
    seen = {}
    real = sharding.source_ranks
    monkeypatch.setattr(sharding, "source_ranks", lambda rows: seen.setdefault("ranked", real(rows)))
    blocks = sharding.one_by_one
    monkeypatch.setattr(sharding, "one_by_one", lambda rows: blocks(rows, 64))
    got = sharding.shard_documents(spark.createDataFrame(data, DOCS)).collect()
    slices = Counter((r["source"], r["slice"]) for r in seen["ranked"].select("source", "slice").collect())
    assert max(slices.values()) <= 12
    assert Counter((r["doc_id"], r["source"], r["text_crc32"]) for r in got) == Counter((d[0], d[3], zlib.crc32(d[1].encode())) for d in data)
    sizes = Counter(r["shard"] for r in got)
    assert set(sizes.values()) == {375} and all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(375)) for s in sizes)


def test_sharding_awkward(spark):
    assert sharding.shard_documents(clashing(spark)).count() == len(AWKWARD)
    assert sharding.shard_documents(empty(spark)).count() == 0


def _best_fit_brute(lengths, caps, smallest, cost):
    bins = []
    for n in lengths:
        fits = [b for b in bins if b[1] - b[0] >= n]
        if fits:
            b = min(fits, key=lambda b: b[1] - b[0])
        else:
            b = [0, min((c for c in caps if c >= max(n, smallest)), key=lambda c: (cost(c) / c, c))]
            bins.append(b)
        b[0] += n
    return sorted(b[0] for b in bins), sum(cost(min(c for c in caps if c >= b[0])) for b in bins)


def test_best_fit_matches_brute_force():
    rng = random.Random(5)
    caps = (16, 64, 256)
    for _ in range(30):
        lengths = sorted((rng.randint(1, 256) if rng.random() < 0.2 else rng.randint(1, 40) for _ in range(200)), reverse=True)
        for smallest in caps:
            where, offsets, final = packing.best_fit(lengths, caps, smallest, packing.sequence_cost)
            fills = Counter()
            for n, b, o in zip(lengths, where, offsets, strict=True):
                assert o == fills[b]
                fills[b] += n
            want, cost = _best_fit_brute(lengths, caps, smallest, packing.sequence_cost)
            assert sorted(fills.values()) == want
            assert all(final[b] == min(c for c in caps if c >= f) for b, f in fills.items())
            assert sum(map(packing.sequence_cost, final)) == pytest.approx(cost)


def test_packing_covers_every_token_once(spark):
    rng = random.Random(6)
    data = [(i % 700, "z" * rng.choice([0, 5, 90, 300, 1000]), "en", "s", 0) for i in range(1500)] + list(AWKWARD)
    docs = spark.createDataFrame(data, DOCS)
    got = packing.pack_documents(docs, (64, 256, 512), group_rows=200).collect()
    want = Counter((d[0], len((d[1] or "").encode()) + 1) for d in data)
    whole = defaultdict(list)
    for r in got:
        whole[r["doc_id"]].append(r)
    assert {k: sum(x["length"] for x in v) for k, v in whole.items()} == {k: sum(n * c for (d, n), c in want.items() if d == k) for k in whole}
    bins = defaultdict(list)
    for r in got:
        bins[r["pack_group"], r["bin"]].append(r)
    for pieces in bins.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["bin_offset"]):
            assert r["bin_offset"] == at
            at += r["length"]
        assert at == pieces[0]["bin_fill"] and pieces[0]["capacity"] == min(c for c in (64, 256, 512) if c >= at)
    assert packing.pack_documents(empty(spark)).count() == 0
    assert packing.pack_documents(clashing(spark)).select("doc_id").distinct().count() == len({r[0] for r in AWKWARD})
