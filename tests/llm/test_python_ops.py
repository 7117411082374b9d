"""Token counts, language ID, HTML extraction, fingerprints and near-dedup against brute force, and on awkward rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from helpers import AWKWARD, DOCS, LONG, awkward, clashing, empty, rows

from shelfwise.llm import components, fingerprints, html_text, langid, near_dup, tokens
from shelfwise.llm.common import slices


# ---- tokens -----------------------------------------------------------------
def test_suffix_sums_answer_every_limit(spark):
    rng = random.Random(1)
    lengths = [0, 0, 1, 5, 4095, 4096, 4097, 9000] + [rng.randint(0, 300) for _ in range(200)]
    hist = spark.createDataFrame(list(Counter(lengths).items()), "n_tokens long, n_docs long")
    table = tokens.suffix_sums(hist)
    for r in table.collect():
        n = r["n_tokens"]
        assert r["docs_ge"] == sum(x >= n for x in lengths)
        assert r["tokens_ge"] == sum(x for x in lengths if x >= n)
        assert r["truncated_total"] == sum(min(x, n) for x in lengths)
        assert r["quantile"] == pytest.approx(sum(x <= n for x in lengths) / len(lengths))
    limits = [0, 1, 7, 150, 4096, 5000, 10**6]
    assert tokens.answer_limits(table, limits) == {n: sum(min(x, n) for x in lengths) for n in limits}
    assert tokens.answer_quantiles(table, [0.5, 1.0]) == {0.5: sorted(lengths)[len(lengths) // 2 - 1], 1.0: 9000}


def test_token_histogram(spark):
    enc = tokens.Encoder(tokens.VOCABULARY).built()
    got = dict(rows(tokens.length_histogram(clashing(spark)), "n_tokens", "n_docs"))
    assert got == dict(Counter(len(enc.encode_ordinary(r[1] or "")) for r in AWKWARD))
    assert enc.decode(enc.encode_ordinary(LONG[:5000])) == LONG[:5000]
    assert tokens.suffix_sums(tokens.length_histogram(empty(spark))).count() == 0


# ---- language ID ------------------------------------------------------------
def _language_docs():
    rng = random.Random(3)
    parts = {"aa": ["the", "ing", "sh", "on", "ed"], "bb": ["le", "que", "eau", "oi", "é"], "cc": ["sch", "ung", "ein", "ü", "keit"]}
    out = []
    for i in range(600):
        lang = rng.choice(list(parts))
        text = " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(5, 60)))
        out.append((i, text.capitalize() + ".", lang, "s", 0))
    return out


def test_language_accuracy_on_held_out_documents(spark):
    data = _language_docs()
    truth = {d[0]: d[2] for d in data}
    got = langid.language_report(spark.createDataFrame(data, DOCS), sample_docs=60, calibration_docs=40).collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == 600 and 100 < len(held) < 300
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.98
    assert not any(r["rejected"] for r in held) and all(0 <= r["score"] <= 1 for r in got)
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)


def test_noisy_labels_end_no_job(spark):
    data = _language_docs()
    truth = {d[0]: d[2] for d in data}
    noisy = data + [(1000 + i, data[i % 600][1], f"free text {i}", "s", 0) for i in range(2 * langid.MAX_LANGUAGES)]
    got = langid.language_report(spark.createDataFrame(noisy, DOCS), sample_docs=60, calibration_docs=40).collect()
    assert len(got) == len(noisy) and {r["lang_pred"] for r in got} == {"aa", "bb", "cc"}
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in got if r["doc_id"] < 600) > 0.98 * 600
    unknown = spark.createDataFrame([d for d in noisy if d[0] >= 1000], DOCS)
    assert {r["lang_pred"] for r in langid.language_report(unknown).collect()} == {"und"}


def test_kneser_ney_sums_to_one_and_matches_plain_lookup():
    counts = {"x": Counter(), "y": Counter()}
    for lang, text in (("x", "    abra cadabra "), ("y", "    banana bandana ")):
        for i in range(len(text) - langid.ORDER + 1):
            counts[lang][text[i : i + langid.ORDER]] += 1
    model = langid.kneser_ney({k: dict(v) for k, v in counts.items()}, langid.letter_map())
    alphabet = sorted({c for g in counts.values() for x in g for c in x})
    for context in ("abra", "    ", "zzzz", "nana", "bcda"):
        windows = [np.array([ord(c)] * len(alphabet), np.uint32) for c in context] + [np.array([ord(c) for c in alphabet], np.uint32)]
        p = np.exp(model.log_probabilities(windows))
        unseen = np.exp(model.log_probabilities([np.array([ord(c)], np.uint32) for c in context + "q"]))
        assert p.sum(0) + unseen[0] == pytest.approx([1, 1], abs=1e-4)


def test_letters_only_is_local():
    letters = langid.letter_map()
    texts = ["Ab, c!", "...", "É1x", "", "a\U00020000b"]
    together, ends, n = langid.letters_only(texts, letters)
    starts = [0, *ends[:-1]]
    got = ["".join(map(chr, together[a:b])) for a, b in zip(starts, ends, strict=True)]
    assert got == ["    ab c ", "    ", "    é x ", "    ", "    a\U00020000b "]
    assert n.tolist() == [3, 0, 2, 0, 3]


def test_language_awkward(spark):
    got = langid.language_report(awkward(spark)).collect()
    by_text = {r["doc_id"]: r for r in got}
    assert len(got) == len(AWKWARD)
    assert all(by_text[k]["lang_pred"] == "und" and by_text[k]["score"] == 0 for k in (2, 3, 4, -7))
    assert langid.language_report(empty(spark)).count() == 0
    assert langid.language_filter(clashing(spark)).columns == clashing(spark).columns
    unlabelled = spark.createDataFrame([(1, "some words", None, "s", 0), (2, "77", None, "s", 0)], DOCS)
    assert rows(langid.language_report(unlabelled), "doc_id", "lang_pred", "rejected") == [(1, "und", False), (2, "und", True)]


# ---- HTML -------------------------------------------------------------------
PAGES = [
    ("<html><body><nav><a href=a>Home</a></nav><article><h1>A &amp; B</h1><p>One <b>tw</b>o<br>three &lt;x&gt;</p><p>four</article><footer>c</footer>", "A & B One two three <x> four"),
    ("<div class=menu><a>x</a></div><div id=main-text><p>" + "long words here " * 30 + "</p><p>" + "more text " * 40 + "</p></div><div class='comments'><p>" + "I agree with all " * 60 + "</p></div>",
     ("long words here " * 30 + "more text " * 40).strip()),
    ("<main><section><h2>S</h2><p>aaa bbb</p></section><section><p>ccc</p><aside>no</aside></section><form><input><p>sign</p></form></main>", "S aaa bbb ccc"),
    ("<article><p>x<script>if (a<b) '</p>'</script>y</p><style>p{}</style><!-- <p>no</p> --><p hidden>no</p>z</article>", "xy z"),
    ("plain &eacute;  text", "plain é text"),
    ("<p>a<p>b<div>c", "a b c"),
    ("<article><ul><li>one<li>two</ul><table><tr><td>3<td>4</table></article>", "one two 3 4"),
    ("<article>a < b &unknown; <3</article>", "a < b &unknown; <3"),
    ("<!-- never closed <p>x", ""), ("", ""), (None, ""), ("<p>  </p>", ""),
]


@pytest.mark.parametrize("page,text", PAGES)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


WORDS = "some plain words of prose "
NAMED = [
    ("<body><div class='right-sidebar'><div class=post><p>whole text</p></div></div></body>", "whole text"),
    ("<div class='layout sidebar-right'><div class=sidebar><a>x</a> y</div><p>" + WORDS * 9 + "</p></div><div class=comments><p>" + WORDS * 40 + "</p></div>", (WORDS * 9).strip()),
    ("<article><p>a</p><section id='related-work'><p>b</p></section><h2 id='discussion'>C</h2><p>d</p><div class='entry-header'><h1>Title</h1></div></article>", "a b C d Title"),
    ("<article><h2 class='notice'>N</h2><section class='related-work'><p>" + WORDS + "</p></section><div class='related'><a>other page</a></div></article>", "N " + WORDS.strip()),
    ("<div class=post><div class='post-header'><h1>Title</h1></div><p>" + WORDS * 20 + "</p></div><div class=sidebar><p>" + WORDS + "</p></div>", "Title " + (WORDS * 20).strip()),
    ("<div class='nav'><a>Home</a> | <a>Up</a></div>", ""),
    ("<div class='widget'>" * 20_000 + "deep", "deep"),
]


PROSE = (WORDS * 12).strip()
LONGER = (WORDS * 30).strip()
ARTICLE = f"<h1>T</h1><p>{PROSE}</p>"
# boilerplate that a name says and the page's structure confirms, whatever its length
STRUCTURE = [
    *[(f"<main><article>{ARTICLE}</article><div id='comments'><p>{LONGER}</p></div></main>", "T " + PROSE)],
    *[(f"<article>{ARTICLE}<div id='comments'><h3>2 Comments</h3><p>{LONGER}</p></div></article>", "T " + PROSE)],
    *[(f"<article>{ARTICLE}<div class='{c}'><p>{x}</p></div></article>", "T " + PROSE) for c in ("notice", "alert", "promotion", "advertising", "site-notice") for x in (WORDS, LONGER)],
    *[(f"<body><div class=content>{ARTICLE}</div><div class='{c}'><p>{WORDS * 3}</p></div></body>", "T " + PROSE) for c in ("notice", "alert", "promotion", "advertising")],
    *[(f"<article>{ARTICLE}<div id='{i}'><p>{WORDS * 8}</p></div></article>", "T " + PROSE) for i in ("ad-slot", "sidebar", "footer", "respond")],
    *[(f"<main>{ARTICLE}<div id='{i}'><p>{LONGER}</p></div></main>", "T " + PROSE) for i in ("ad-slot", "sidebar", "footer")],
    *[(f"<div class=content>{ARTICLE}</div><div class='{c}'><p>{LONGER}</p></div>", "T " + PROSE) for c in ("sidebar", "footer", "site-footer")],
    *[(f"<article><p>One line.</p></article><div class='{c}'><p>{LONGER}</p></div>", "One line.") for c in ("sidebar", "right-sidebar")],
    (f"<div class=post><p>One line.</p></div><div class=sidebar><p>{LONGER}</p></div>", "One line."),
    (f"<article><p>One line.</p></article><form><p>{LONGER}</p></form>", "One line."),
    (f"<article><p>One line.</p><form><label>{LONGER}</label></form></article>", "One line."),
    # what only looks like it
    (f"<form><div class=content>{ARTICLE}</div><p>{WORDS}</p></form><p>c 2020</p>", f"T {PROSE}"),
    (f"<main><p>crumb</p><div class='right-sidebar'><div class='post-content'><p>{PROSE}</p></div></div></main>", "crumb " + PROSE),
    (f"<article><section id='comments'><h2>Comments</h2><p>A</p></section><section id='strings'><h2>Strings</h2><p>{PROSE}</p></section></article>", f"Comments A Strings {PROSE}"),
    (f"<article><div class='section' id='discussion'><h2>4 Discussion</h2><p>{LONGER}</p></div><p>{PROSE}</p></article>", f"4 Discussion {LONGER} {PROSE}"),
    (f"<article><p>{PROSE}</p><div id='notice-period'><p>b</p></div><dl><dt id='menu'>menu</dt><dd>c</dd></dl><span id='banner'>d</span></article>", f"{PROSE} b menu c d"),
    (f"<article><section id='notice'><h2>Notice</h2><p>{WORDS}</p></section><p>{PROSE}</p></article>", f"Notice {WORDS}{PROSE}"),
]


@pytest.mark.parametrize("page,text", STRUCTURE, ids=range(len(STRUCTURE)))
def test_names_and_structure(page, text):
    assert html_text.main_text(page) == text


def _plain_article(source):
    """(sum of the children's densities) of each element by the formula's own definition, element by element."""
    page = html_text.Page(source)
    out, n = page.boilerplate(), len(page.tag)
    under = lambda i, j: i == j or (j > 0 and under(i, page.parent[j]))
    link = lambda j: j > 0 and (page.tag[j] == "a" or link(page.parent[j]))
    size = lambda keep: sum(len("".join(t.split())) for e, t in page.text if not out[e] and keep(e))
    body, body_links = size(lambda e: True), size(link)

    def density(i):
        c, lc = size(lambda e: under(i, e)), size(lambda e: under(i, e) and link(e))
        below = [j for j in range(1, n) if j != i and under(i, j) and not out[j]]
        t, lt = max(len(below), 1), max(sum(page.tag[j] == "a" for j in below), 1)
        if not c:
            return 0.0
        x = c / max(lc, 1) * t / lt
        y = math.log(c / max(c - lc, 1) * max(lc, 1) + body_links / max(body, 1) * c + math.e)
        return max(0.0, c / t * math.log(x) / math.log(y))

    values = [density(i) for i in range(n)]
    sums = [0.0 if out[i] else sum(values[j] for j in range(1, n) if page.parent[j] == i and not out[j]) for i in range(n)]
    return page, out, values, sums


def test_html_densities_match_their_definition():
    rng = random.Random(5)
    for _ in range(15):
        parts = [f"<div>{''.join(rng.choice(['<p>' + WORDS * rng.randint(0, 6) + '</p>', '<a>link</a>', '<ul><li>x<li><a>y y</a></ul>', '<div><p>' + WORDS + '</p><p>b <a>c</a></p></div>']) for _ in range(rng.randint(0, 6)))}</div>" for _ in range(rng.randint(1, 5))]
        page, out, values, sums = _plain_article("".join(parts))
        assert html_text.densities(page, out) == pytest.approx(values)
        inside, _ = html_text.article(page)
        core = max(range(len(sums)), key=lambda i: (not out[i], round(sums[i], 9), -i))
        assert inside[core] or sums[core] == 0
        path, i = [core], core
        while i:
            i = page.parent[i]
            path.append(i)
        threshold = min(values[i] for i in path)
        for j in range(1, len(sums)):
            # a neighbour on the path is in exactly if its density reaches the threshold
            if core and sums[core] > 0 and page.parent[j] in path[1:] and j not in path and not out[j]:
                assert inside[j] == (values[j] >= threshold)


@pytest.mark.parametrize("page,text", NAMED, ids=range(len(NAMED)))
def test_a_name_alone_drops_little(page, text):
    assert html_text.main_text(page) == text


def test_html_long_and_deep_pages():
    assert html_text.main_text("<div>" * 30_000 + "deep" + "</div>" * 30_000) == "deep"
    assert html_text.main_text("<b>" * 20_000 + "<p>x</p>" * 20_000).count("x") == 20_000
    assert html_text.main_text("<article><p>" + "word " * 200_000) == ("word " * 200_000).strip()


def test_html_densities():
    page = html_text.Page("<div><p>" + "x" * 500 + "</p></div><div>" + "<a>link text</a>" * 30 + "</div>")
    found = dict(zip(page.tag, html_text.densities(page, page.boilerplate())))
    assert found["p"] > 100 * found["a"]


def test_html_query_rows(spark):
    df = spark.createDataFrame([(i, None, p, "x", "y") for i, (p, _) in enumerate(PAGES)], "page_id long, url string, html string, text string, HTML_ string")
    got = html_text.extract(df).orderBy("page_id").collect()
    assert [r["text"] for r in got] == [t for _, t in PAGES] and all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_text.extract(df.limit(0)).count() == 0


# ---- fingerprints -----------------------------------------------------------
def _prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_parsing_is_local():
    rng = random.Random(7)
    core = _prose(rng, 400)
    a, b = _prose(rng, 50) + core + _prose(rng, 30), "ü" * 13 + core
    (na, ea), (nb, eb) = (fingerprints.phrase_names([t], 2)[1] for t in (a, b))
    alone = set(fingerprints.phrase_names([core], 2)[1][0].tolist())
    for names in (na, nb):
        assert len(alone - set(names.tolist())) <= 12 < len(alone)
    # parsing together or alone makes no difference
    together, ends = fingerprints.phrase_names([a, core, b], 2)[1]
    assert together[: ends[0]].tolist() == na.tolist() and together[ends[1] :].tolist() == nb.tolist()


def test_phrases_are_short_and_cover():
    rng = random.Random(8)
    for text in ("aaaaaaaaaaaaaaaaaaaa", "abababababababababab", _prose(rng, 500), "x"):
        sym, ends = fingerprints.next_level(fingerprints.CODE_NAMES[np.array([ord(c) for c in text])], np.array([len(text)]), 1)
        assert ends[-1] == len(sym) and (len(sym) >= len(text) / 16 or text[:2] == "aa")


def test_likeness():
    rng = random.Random(9)
    a, b = _prose(rng, 600), _prose(rng, 600)
    sa, sb, near, none = fingerprints.sketches([a, b, a[: len(a) // 2] + b[len(b) // 2 :], ""])
    assert fingerprints.likeness(sa, sa) == 1 and fingerprints.likeness(sa, sb) < 0.1
    assert 0.15 < fingerprints.likeness(sa, near) < 0.55
    assert fingerprints.likeness(none, none) == 1 and fingerprints.likeness(none, sa) == 0


@pytest.mark.parametrize("bucket_rows", [2, 4096])
def test_edit_report(spark, bucket_rows, monkeypatch):
    rng = random.Random(10)
    data = [(i * 37 % 5003 - 600, _prose(rng, rng.randint(0, 60)), "en", "s", 0) for i in range(300)]
    data += [(9000, None, "en", "s", 0), (9001, "", "en", "s", 0), (9002, LONG, "en", "s", 0), (9003, data[5][1], "en", "s", 0)]
    order = sorted(data)
    real = fingerprints.in_id_order
    monkeypatch.setattr(fingerprints, "in_id_order", lambda d: real(d, bucket_rows))
    got = {r["doc_id"]: r for r in fingerprints.edit_report(spark.createDataFrame(data, DOCS)).collect()}
    assert len(got) == len(data)
    sketches = fingerprints.sketches([d[1] or "" for d in order])
    for i, d in enumerate(order):
        t, nxt, r = d[1] or "", order[(i + 1) % len(order)][1] or "", got[d[0]]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == fingerprints.as_text(sketches[i])
        assert r["edited_fingerprint"] == fingerprints.as_text(fingerprints.sketches([edited])[0])
        assert r["near_next"] == fingerprints.likeness(sketches[i], sketches[(i + 1) % len(order)])
    assert got[9003]["fingerprint"] == got[data[5][0]]["fingerprint"]


@pytest.mark.parametrize("kind", ["outlier", "clusters", "nulls", "one id", "one row"])
def test_buckets_follow_the_rows(spark, kind):
    rng = random.Random(3)
    ids = {"outlier": [*range(2999), 10**12], "clusters": [10**9 * (i % 3) + i for i in range(3000)]}.get(kind, [None if i % 3 == 0 and kind == "nulls" else 7 if i % 3 == 0 else i * 5 for i in range(3000)])
    data = [(k, "same" if kind == "one row" and k == 7 else _prose(rng, 6), "en", "s", 0) for k in ids]
    rows_ = fingerprints.in_id_order(spark.createDataFrame(data, DOCS).repartition(3), 100).collect()
    sizes = Counter(r["bucket"] for r in rows_ if not r["halo"])
    assert sum(sizes.values()) == 3000 and 25 <= len(sizes) and max(sizes.values()) <= 2 * 3000 / len(sizes)
    assert Counter(r["bucket"] for r in rows_ if r["halo"]) == Counter(dict.fromkeys(sizes, 1))
    # the buckets joined are the order by id, and each halo row is the next bucket's first
    order = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0)
    runs = {b: [r for r in rows_ if r["bucket"] == b and not r["halo"]] for b in sorted(sizes)}
    flat = [r for b in sorted(runs) for r in runs[b]]
    assert [order(r) for r in flat] == sorted(order(r) for r in flat)
    assert Counter((r["doc_id"], r["text"]) for r in flat) == Counter(d[:2] for d in data)
    following = dict(zip(sorted(runs), [*sorted(runs)[1:], min(runs)], strict=True))
    for r in rows_:
        if r["halo"]:
            first = runs[following[r["bucket"]]][0]
            assert (r["doc_id"], r["text"]) == (first["doc_id"], first["text"])


def test_fingerprints_awkward(spark):
    got = fingerprints.edit_report(clashing(spark)).collect()
    assert len(got) == len(AWKWARD)
    assert len({r["fingerprint"] for r in got if r["doc_id"] in (1, 6)}) == 1
    assert fingerprints.edit_report(empty(spark)).count() == 0
    one = fingerprints.edit_report(spark.createDataFrame([(5, "abcd", "en", "s", 4)], DOCS)).collect()[0]
    assert one["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and one["near_next"] == 1
    assert fingerprints.fingerprint(awkward(spark)).count() == len(AWKWARD)


# ---- near-dedup -------------------------------------------------------------
def _set(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset([tuple(w)]) if w else frozenset()


def _components(data):
    sets = {k: _set(t) for k, t, *_ in data if k is not None}
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        i = len(sets[a] & sets[b])
        if i and 100 * i >= 80 * (len(sets[a]) + len(sets[b]) - i):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {k: (len(s), find(k)) for k, s in sets.items()}


def _near_copies(rng, n_groups, size, words, changes):
    out = []
    for _ in range(n_groups):
        base = _prose(rng, words).split()
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randint(0, changes)):
                w[rng.randrange(len(w))] = _prose(rng, 1)
            out.append(" ".join(w))
    return out


def test_shingle_sets_match_plain_sets():
    rng = random.Random(11)
    texts = [None, "", " ", "one", "One one", "a b a b", "\x0b\x1ca b c", LONG, "w" * 5000 + " x"] + [_prose(rng, rng.randint(0, 80)) for _ in range(50)]
    got = near_dup.shingle_sets(texts)
    assert [len(s) for s in got] == [len(_set(t)) for t in texts]
    assert (near_dup.shingle_sets(["The CAT"])[0] == near_dup.shingle_sets(["the cat\n"])[0]).all()
    for a, b in combinations(range(9, 30), 2):
        assert len(np.intersect1d(got[a], got[b])) == len(_set(texts[a]) & _set(texts[b]))


def test_sketch_estimates_similarity():
    rng = random.Random(12)
    a, b = (near_dup.shingle_sets([t])[0] for t in _near_copies(rng, 1, 2, 800, 40))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    est = near_dup.matches(near_dup.sketch(a)[None], near_dup.sketch(b)[None])[0] / near_dup.COORDINATES
    assert abs(true - est) < 0.2


@pytest.mark.parametrize("leaf", [64, 12])
def test_near_duplicates_match_brute_force(spark, leaf, monkeypatch):
    # a small leaf makes this corpus branch over several levels, with leaders and settled nodes
    monkeypatch.setattr(near_dup, "LEAF", leaf)
    rng = random.Random(13)
    texts = _near_copies(rng, 12, 6, 60, 8) + _near_copies(rng, 1, 40, 100, 8) + ["same old text", "Same  OLD text"] * 20 + [_prose(rng, 30) for _ in range(60)]
    data = [(i * 3 - 50, t, "en", "s", 0) for i, t in enumerate(rng.sample(texts, len(texts)))] + [(10_000, None, "en", "s", 0), (10_001, "", "en", "s", 0), (10_002, " ", "en", "s", 0)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(spark.createDataFrame(data, DOCS)).collect()}
    want = _components(data)
    assert got == want
    kept = near_dup.drop_near_duplicates(spark.createDataFrame(data, DOCS))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(k for k, (_, c) in want.items() if k == c)


def test_near_duplicates_write_small_tables_in_few_files(spark, monkeypatch):
    # the documents come in 40 partitions; each file costs an executor child processes where the checkpoint folder is local
    files: dict[str, int] = {}
    write = near_dup.materialize

    def counted(df, name, *registry):
        table = write(df, name, *registry)
        files[name] = max(files.get(name, 0), len(table.inputFiles()))
        return table

    monkeypatch.setattr(near_dup, "LEAF", 12)
    monkeypatch.setattr(near_dup, "materialize", counted)
    rng = random.Random(14)
    texts = _near_copies(rng, 30, 4, 60, 3) + _near_copies(rng, 1, 40, 100, 8) + [_prose(rng, 30) for _ in range(120)]
    data = [(i, t, "en", "s", 0) for i, t in enumerate(rng.sample(texts, len(texts)))]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(spark.createDataFrame(data, DOCS).repartition(40)).collect()}
    assert got == _components(data)
    small = ("shingle_sets", "set_classes", "wanted_texts", "links", "open_texts", "open_links")
    assert all(files[name] <= 8 for name in small), files


def test_trees_reach_the_recall_with_one_sketch():
    assert near_dup.trees_at(3) >= 12 and near_dup.trees_at(5) >= 21
    g = np.random.default_rng(21)
    pairs, level = 40_000, 3
    a = g.integers(0, 256, (pairs, near_dup.COORDINATES), np.uint8)
    b = np.where(g.random(a.shape) < 0.8, a, g.integers(0, 256, a.shape, np.uint8))
    found = np.zeros(pairs, bool)
    for tree in range(near_dup.plan_trees(250_000)[1]):
        row = np.arange(pairs)
        node = near_dup.mix64(row.astype(np.uint64) * np.uint64(1000) + np.uint64(tree + 1))
        for _ in range(level):
            (up, x), (_, y) = near_dup.branch(node, a[row]), near_dup.branch(node, b[row])
            row, node = row[up][x == y], x[x == y]
        found[row] = True
    assert (~found).sum() <= 10  # 4 expected


@pytest.mark.parametrize("row_cost", [near_dup.ROW_COST, 1])
def test_pairs_at_the_threshold_inside_a_family(spark, row_cost, monkeypatch):
    # members share about 2/3 of their shingles, partners 0.8 to 0.82; sketches propose, plain sets confirm.
    # With the small row cost large nodes are branched over several levels before all pairs are compared.
    monkeypatch.setattr(near_dup, "ROW_COST", row_cost)
    rng = random.Random(22)
    base = [f"b{i}" for i in range(300)]

    def changed(words, n, name):
        out = list(words)
        for at in rng.sample(range(1, 299, 2), n):
            out[at] = f"{name}x{at}"
        return out

    family = [changed(base, 17, f"m{i}") for i in range(400)]
    texts = family + [changed(family[i], 16, f"p{i}") for i in range(40)]
    data = [(i, " ".join(w), "en", "s", 0) for i, w in enumerate(texts)]
    sets = {d[0]: _set(d[1]) for d in data}

    def confirmed(pairs, docs, written):
        both = pairs.distinct().toArrow().to_pydict()
        shared = ((x, y, len(sets[x] & sets[y])) for x, y in zip(both["a"], both["b"], strict=True))
        links = [(x, y) for x, y, n in shared if 100 * n >= 80 * (len(sets[x]) + len(sets[y]) - n)]
        return spark.createDataFrame(links, "a long, b long")

    monkeypatch.setattr(near_dup, "confirmed", confirmed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(spark.createDataFrame(data, DOCS)).collect()}
    want = _components(data)
    assert sum(c != k for k, (_, c) in want.items()) >= 40
    assert got == want


def _links_of(df):
    return {tuple(sorted((r["a"], r["b"]))) for r in df.collect()}


def _family(rng, n, changes):
    base = [f"b{i}" for i in range(60)]
    out = []
    for i in range(n):
        w = list(base)
        for at in rng.sample(range(60), rng.randint(0, changes)):
            w[at] = f"m{i}x{at}"
        out.append(" ".join(w))
    return out


def _merged(comp, links):
    up = {c: c for c in comp.values()}

    def find(c):
        while up[c] != c:
            c = up[c]
        return c

    for a, b in links:
        up[find(comp[a])] = find(comp[b])
    return {frozenset(k for k in comp if find(comp[k]) == find(comp[r])) for r in comp}


@pytest.mark.parametrize("shingles", [10, 12 * near_dup.BLOCK_SHINGLES])
def test_all_pairs_of_open_classes(spark, shingles):
    rng = random.Random(23)
    texts = _family(rng, 90, 12)
    sets = [_set(t) for t in texts]
    comp = {i: i % 70 for i in range(90)}
    marks = [near_dup.sketch(s).tobytes() for s in near_dup.shingle_sets(texts)]
    classes = spark.createDataFrame([(i, comp[i], len(sets[i]), bytearray(marks[i])) for i in range(90)], "cid long, comp long, size long, sketch binary")
    got = _links_of(near_dup.link_all(classes, spark.createDataFrame(list(enumerate(texts)), "cid long, text string"), shingles))
    every = {(i, j) for i, j in combinations(range(90), 2) if comp[i] != comp[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    # only true links, and enough of them to join whatever all of them join
    assert got and got <= every and _merged(comp, got) == _merged(comp, every)
    assert 0 < len(_merged(comp, every)) < 70


def test_outsiders_meet_all_members(spark):
    rng = random.Random(24)
    texts = _family(rng, 300, 12)
    sets = [_set(t) for t in texts]
    comp = {i: 1000 + i if i % 10 == 0 else 5 for i in range(300)}
    marks = [near_dup.sketch(s).tobytes() for s in near_dup.shingle_sets(texts)]
    data = [(i % 2, i, comp[i], len(sets[i]), bytearray(marks[i]), comp[i] != 5) for i in range(300)]
    open_rows = spark.createDataFrame(data, "node long, cid long, comp long, size long, sketch binary, outside boolean")
    masked = near_dup.outsider_masks(open_rows)
    assert masked.count() <= 300
    docs = spark.createDataFrame([*enumerate(texts), (0, "another text under the same id")], "cid long, text string")
    got = _links_of(near_dup.confirm_masks(masked, docs))
    every = {(i, j) for i, j in combinations(range(300), 2) if i % 2 == j % 2 and comp[i] != comp[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    assert got and got <= every and _merged(comp, got) == _merged(comp, every)
    assert len(got) <= 30  # at most one for each outsider, not one for each member that it is near


def test_branching_ends_by_cost():
    # the branching ends by its own cost, for any number of classes, before rows grow without bound
    assert any(near_dup.ROW_COST * near_dup.trees_at(level) * 1.25**level > 10**9 for level in range(40))


def test_near_duplicates_awkward(spark):
    got = near_dup.near_duplicates(clashing(spark))
    assert got.count() == len(AWKWARD)
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[6]["component_id"] == 1 and not by[6]["kept"] and by[None]["component_id"] is None and by[None]["kept"]
    out = near_dup.drop_near_duplicates(clashing(spark))
    assert out.columns == clashing(spark).columns
    twice = spark.createDataFrame([(5, "a b c", "en", "s", 0), (5, "a b c", "en", "s", 0), (5, "other words", "en", "s", 0), (6, "other words", "en", "s", 0)], DOCS)
    assert rows(near_dup.near_duplicates(twice), "doc_id", "component_id") == [(5, 5), (5, 5), (5, 5), (6, 5)]
    assert near_dup.drop_near_duplicates(twice).count() == 1
    assert near_dup.near_duplicates(empty(spark)).count() == 0
    assert near_dup.drop_near_duplicates(empty(spark)).count() == 0


def test_components(spark):
    rng = random.Random(14)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1020)] + [(2000, x) for x in range(2001, 2100)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = dict(rows(components.connected(spark.createDataFrame(edges, "a long, b long"), []), "node", "component"))
    assert got == {k: find(k) for k in parent if find(k) != k}


def test_tree_plan():
    level, trees = near_dup.plan_trees(1_000_000)
    assert 1 - (1 - near_dup.survival(level)) ** trees >= near_dup.TARGET_RECALL
    assert near_dup.plan_trees(0)[0] == near_dup.plan_trees(10)[0] == 1


def test_slices():
    assert list(slices([], 5)) == [] and list(slices([9], 5)) == [(0, 1)] and list(slices([1, 5, 2, 2], 5)) == [(0, 2), (2, 4)]

