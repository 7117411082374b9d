"""Registered queries against their SQL, and the pipeline against its stages."""

from __future__ import annotations

import hashlib
import math
import os
import subprocess
import sys
from collections import Counter

import duckdb
import pytest
from helpers import AWKWARD, clashing, empty, rows
from test_native_ops import _quality_brute
from test_python_ops import _components

import corpus_pipeline
from shelfwise.llm import langid, near_dup, packing, quality
from shelfwise.llm.common import table
from shelfwise.llm.queries import ORACLES, QUERIES

TABLES = "documents pages conversations benchmark"
REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="module")
def duck(sf_small):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_small, duck, name):
    got = QUERIES[name](spark, sf_small)
    want = duck.execute(ORACLES[name])
    cols = [d[0] for d in want.description]
    assert sorted(cols) == sorted(got.columns)
    plain = lambda v: round(v, 9) if isinstance(v, float) and math.isfinite(v) else v
    key = lambda r: [str(x) for x in r]
    assert sorted((tuple(map(plain, r)) for r in rows(got, *cols)), key=key) == sorted((tuple(map(plain, r)) for r in want.fetchall()), key=key)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs_over_all_rows(spark, sf_small, name):
    got = QUERIES[name](spark, sf_small)
    n = got.count()
    if name in ("op2_language_id", "op8_document_fingerprints", "op13_quality_classifier"):
        assert n == table(spark, sf_small, "documents").count()
    elif name == "op7_html_extraction":
        assert n == table(spark, sf_small, "pages").count()
    else:
        assert n > 0


def test_pipeline_decisions_take_effect(spark, sf_small):
    docs = table(spark, sf_small, "documents")
    recognised = langid.language_filter(docs)
    good = quality.quality_filter(recognised)
    report = quality.quality_report(recognised)
    assert good.count() == report.where("size(failed_rules) = 0").count()
    distinct = near_dup.drop_near_duplicates(good)
    groups = near_dup.near_duplicates(good)
    assert distinct.count() == groups.select("component_id").distinct().count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_small)
        assert out.columns == docs.columns, name
    packed = corpus_pipeline.run(spark, sf_small)
    mixed = corpus_pipeline.mix_to_weights(spark, distinct, sf_small)
    tokens = sum(len((r["text"] or "").encode()) + 1 for r in mixed.select("text").collect())
    assert sum(r["length"] for r in packed.select("length").collect()) == tokens
    assert all(r["bin_fill"] <= r["capacity"] for r in packed.select("bin_fill", "capacity").distinct().collect())
    assert {r["capacity"] for r in packed.select("capacity").distinct().collect()} <= set(packing.CAPACITIES)


def _passes(text):
    words, chars, symbols, dup_lines, repeated = _quality_brute(text)
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    stops = {f(w) for w in quality.STOP_WORDS.split() for f in (str.lower, str.capitalize, str.upper)}
    plain = [w for w in (text or "").replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\r", " ").replace("\n", " ").split(" ") if w]
    return (
        words >= 50 and 2 * repeated <= words and 2 * words <= chars <= 20 * words and symbols <= 0.3 * words
        and dup_lines <= 0.3 * max(len(lines), 1) and sum(w in stops for w in plain) >= 0.01 * words
    )


def _replicas(docs, seed=17):
    """Copies of each document: the Poisson quantile of its seeded uniform number at its source's rate."""
    volume = Counter()
    for _, text, source in docs:
        volume[source] += len((text or "").encode())
    roots = sum(math.sqrt(v) for v in volume.values())
    out = Counter()
    for doc_id, text, source in docs:
        rate = math.sqrt(volume[source]) / roots * sum(volume.values()) / volume[source]
        u = int(hashlib.md5(f"{seed}:{doc_id}".encode()).hexdigest()[:13], 16) / 2**52
        k, p = 0, math.exp(-rate)
        below = p
        while below <= u and k < 1000:
            k += 1
            p *= rate / k
            below += p
        if k:
            out[doc_id] = k
    return out


def test_pipeline_equals_a_plain_version(spark, sf_small):
    """Rules, similarity of all pairs, Poisson draws and packed lengths again, one document at a time; only the language verdicts are the models'."""
    docs = table(spark, sf_small, "documents")
    rejected = {r["doc_id"] for r in langid.language_report(docs).where("rejected").collect()}
    every = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    good = [d for d in every if d[0] not in rejected and _passes(d[1])]
    component = _components(good)
    kept = [d for d in good if component[d[0]][1] == d[0]]
    want = _replicas(kept)
    text = {d[0]: d[1] for d in kept}
    got = corpus_pipeline.run(spark, sf_small).collect()
    pieces = Counter((r["doc_id"], r["copy"]) for r in got)
    assert Counter(k[0] for k in pieces) == want and len(kept) < len(good) < len(every)
    length = Counter()
    for r in got:
        length[r["doc_id"], r["copy"]] += r["length"]
    assert all(n == len(text[k[0]].encode()) + 1 for k, n in length.items())
    fill = Counter()
    for r in got:
        fill[r["pack_group"], r["bin"]] += r["length"]
    assert all(fill[r["pack_group"], r["bin"]] == r["bin_fill"] <= r["capacity"] for r in got)
    # downsized: no smaller permitted length holds the bin
    assert all(not any(r["bin_fill"] <= c < r["capacity"] for c in packing.CAPACITIES) for r in got)


def test_pipeline_awkward(spark):
    assert corpus_pipeline.run_stages(spark, empty(spark), "").count() == 0
    words = " ".join(f"the w{i}" for i in range(40))
    more = [(100 + i, f"{words} {i}", "en", "a", None, *"x" * (len(clashing(spark).columns) - 5)) for i in range(30)]
    odd = clashing(spark).union(spark.createDataFrame(more + more[:3], clashing(spark).schema))
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == odd.columns, name
    got = corpus_pipeline.run_stages(spark, odd, "")
    known = {r[0] for r in AWKWARD} | {r[0] for r in more}
    assert {r["doc_id"] for r in got.select("doc_id").distinct().collect()} <= known


ELSEWHERE = """
import sys
sys.path.insert(0, sys.argv[1])
import builtins
from shelfwise.session import local_session
from shelfwise.llm import langid, near_dup, quality_model, ranking, spelling, tokens
spark = local_session(2, shuffle_partitions=2, **{"spark.ui.showConsoleProgress": "false"})
try:
    spark.sparkContext.parallelize([0], 1).map(lambda x: __import__("shelfwise")).count()
    raise SystemExit("workers find the library")
except Exception as e:
    assert "No module named 'shelfwise'" in str(e)
docs = spark.createDataFrame([(i, "the cat of house %d sat " % (i % 5) * 9, ["en", "de"][i % 2], "s", 0) for i in range(60)], "doc_id long, text string, lang string, source string, n_chars long")
labels = spark.createDataFrame([(i, i % 3 and 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
assert tokens.length_histogram(docs).count() >= 1
assert langid.language_report(docs).count() == 60
assert near_dup.near_duplicates(docs).count() == 60
assert ranking.rank_documents(docs, spark.createDataFrame([(1, "cat")], "item_id long, text string")).count() == 10
assert spelling.spelling_variants(docs).count() >= 0
assert quality_model.quality_scores(docs, labels).count() == 60
print("done")
"""


def test_workers_need_no_copy_of_the_library(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    (tmp_path / "job.py").write_text(ELSEWHERE)
    out = subprocess.run([sys.executable, "job.py", REPO], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0 and out.stdout.strip().endswith("done"), out.stderr[-2000:]


def test_entry_imports_without_a_tokenizer_package():
    code = "import sys; sys.modules['tiktoken'] = None; import __spark_entry__ as e; print(len(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0 and int(out.stdout.split()[-1]) > 100, out.stderr[-2000:]
