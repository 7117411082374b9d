"""Ranked lexical search by dense blocked BLAS multiplication.

Every document is ranked for every item of a query table.  Texts become
counts of the items' terms once (a written table of compact postings); the
corpus statistics - documents, term occurrences, documents per term - are
aggregates of that table.  Then each task multiplies tiles: the impacts of
some hundred documents over the vocabulary of a tile of items, times the
weights of these items, both dense float64.

Exactness: impacts are integers below 10^6 and weights are integers, so a
product is exact while the weights of an item in one tile add up to less
than 2^53 / 10^6.  Vocabulary tiles are cut so that they do; tiles' scores are
added as 64-bit integers.  Each task keeps the best ``k`` rows of each item
by (score descending, doc_id ascending), which no tie can spoil, and two
ranking steps (salted, then per item) merge the tasks' rows.

The query table is worked through in rounds of a bounded number of (item,
term) pairs, so what a task holds and the driver collects never grows with
the query table, only the number of rounds.  Terms are compared by 64-bit
hashes of their bytes.

Defined cases: null and empty texts have no terms and are never found, and
an item without terms finds nothing.  Rows of the query table that share an
item_id (null is an id, too) are one item with the terms of all of them.
Rows that share a doc_id are ranked each for itself; a null doc_id comes
after all others of its score.  If no document has a term the result is empty.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import columns_of, mix64, slices
from shelfwise.plans.materialize import materialize, remove_written

TOP = 10
DOC_TILE = 256
ITEM_TILE = 64
ROUND_PAIRS = 500_000  # (item, term) pairs that a round holds and broadcasts: 24 bytes each
IMPACT_LIMIT = 1_000_000  # an impact is below this
EXACT = 2**53
SALTS = 64
SLICE_BYTES = 1_000_000

_B = np.arange(256)
# letters and digits of ASCII, and every byte of a longer code point
IN_TERM = ((_B >= 48) & (_B <= 57)) | ((_B >= 65) & (_B <= 90)) | ((_B >= 97) & (_B <= 122)) | (_B >= 128)
_G = np.random.Generator(np.random.PCG64(41))
BYTE_NAMES = _G.integers(0, 2**64, 256, np.uint64)
BYTE_NAMES[65:91] = BYTE_NAMES[97:123]  # A-Z like a-z
PLACES = mix64(np.arange(101, 357, dtype=np.uint64)) | np.uint64(1)


def term_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each term occurrence, end of each text among them)."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    inside = IN_TERM[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    at = np.flatnonzero(begins)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    inner = np.flatnonzero(inside)
    first = np.flatnonzero(begins[inner])
    length = np.diff(np.append(first, len(inner)))
    place = np.arange(len(inner)) - np.repeat(first, length)
    weight = PLACES[place] if length.max() <= len(PLACES) else mix64(place.astype(np.uint64) + np.uint64(101)) | np.uint64(1)
    h = np.add.reduceat(BYTE_NAMES[raw[inner]] * weight, first)
    return mix64(h + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), np.searchsorted(at, ends)


def _texts(column: pa.Array) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in column.to_pylist()]


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, no_id, term (hash), times: the items' terms with their repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms, ends = term_hashes(_texts(b.column(1)))
            rows = np.repeat(np.arange(b.num_rows), np.diff(ends, prepend=0))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(terms.view(np.int64))], ["item_id", "term"])

    rows = columns_of(items, item_id="item_id", text="text")
    kind = rows.schema["item_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"item_id {kind}, term long").groupBy("item_id", "term").agg(F.count("*").alias("times"))


def count_terms(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """doc_id, n (terms with repeats), at, tf: positions in the sorted vocabulary and occurrences, as packed 32-bit numbers."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(shared.value, np.uint64)
        for b in batches:
            n, at, tf = [], [], []
            texts = _texts(b.column(1))
            for i, j in slices(map(len, texts), SLICE_BYTES):
                terms, ends = term_hashes(texts[i:j])
                doc = np.repeat(np.arange(j - i), np.diff(ends, prepend=0))
                n += np.diff(ends, prepend=0).tolist()
                place = np.searchsorted(known, terms)
                place[place == len(known)] = 0
                hit = known[place] == terms if len(known) else np.zeros(len(terms), bool)
                pairs, times = np.unique(doc[hit] * max(len(known), 1) + place[hit], return_counts=True)
                cuts = np.searchsorted(pairs, np.arange(1, j - i) * max(len(known), 1))
                at += [x.tobytes() for x in np.split((pairs % max(len(known), 1)).astype(np.int32), cuts)]
                tf += [x.tobytes() for x in np.split(times.astype(np.int32), cuts)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(at, pa.binary()), pa.array(tf, pa.binary())], ["doc_id", "n", "at", "tf"])

    return docs.mapInArrow(run, "doc_id long, n long, at binary, tf binary")


def document_frequencies(postings: DataFrame, size: int) -> np.ndarray:
    """Documents per vocabulary position; each task sends one row of sums for the positions it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size, np.int64)
        for b in batches:
            sums += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), np.int32), minlength=size)
        met = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(sums[met])], ["at", "df"])

    df = np.zeros(size, np.int64)
    for at, n in postings.select("at").mapInArrow(run, "at long, df long").groupBy("at").agg(F.sum("df")).collect():
        df[at] = n
    return df


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_factor(n: np.ndarray, n_docs: int, occurrences: int) -> np.ndarray:
    return 25 + (75 * n * n_docs) // occurrences


def tiles(item: np.ndarray, term: np.ndarray, weight: np.ndarray, item_tile: int = ITEM_TILE, limit: int = EXACT) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(items, vocabulary positions, weights of the positions by item) of each tile, one at a time.

    The entries come sorted by item.  A tile holds ``item_tile`` items and
    just their terms; its terms are split further where an item's weights
    times the largest impact would reach ``limit``.
    """
    for start in range(0, int(item[-1]) + 1 if len(item) else 0, item_tile):
        a, b = np.searchsorted(item, [start, start + item_tile])
        if a == b:
            continue
        vocabulary, column = np.unique(term[a:b], return_inverse=True)
        dense = np.zeros((len(vocabulary), item_tile))
        dense[column, item[a:b] - start] = weight[a:b]
        width = int(item[b - 1]) - start + 1
        dense = dense[:, :width]
        items = np.arange(start, start + width)
        begin = 0
        while begin < len(vocabulary):
            total = np.cumsum(dense[begin:], axis=0).max(axis=1) * IMPACT_LIMIT
            end = begin + max(1, int(np.searchsorted(total, limit)))
            yield items, vocabulary[begin:end], dense[begin:end]
            begin = end


class Best:
    """The best ``k`` (score, doc_id) rows of each item so far."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.rows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def offer(self, items: np.ndarray, scores: np.ndarray, doc: np.ndarray, no_id: np.ndarray) -> None:
        """Scores by (document, item) of one tile of documents."""
        k = min(self.k, len(doc))
        # no row below a tile's k-th largest score can be among the best; equal ones may
        least = np.maximum(np.partition(scores, len(doc) - k, axis=0)[len(doc) - k], 1)
        for j, i in enumerate(items.tolist()):
            old = self.rows.get(i)
            floor = max(int(least[j]), int(old[0][-1]) if old is not None and len(old[0]) == self.k else 1)
            new = np.flatnonzero(scores[:, j] >= floor)
            if not len(new):
                continue
            s, n, d = scores[new, j], no_id[new], doc[new]
            if old is not None:
                s, n, d = np.concatenate([old[0], s]), np.concatenate([old[1], n]), np.concatenate([old[2], d])
            order = np.lexsort((d, n, -s))[: self.k]
            self.rows[i] = (s[order], n[order], d[order])

    def batch(self) -> pa.RecordBatch:
        items = sorted(self.rows)
        part = lambda x, kind: np.concatenate([self.rows[i][x] for i in items]) if items else np.zeros(0, kind)
        item = np.repeat(np.array(items, np.int64), [len(self.rows[i][0]) for i in items]) if items else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(item), pa.array(part(2, np.int64), mask=part(1, bool)), pa.array(part(0, np.int64))], ["item", "doc_id", "score"])


def tile_scores(at: list[np.ndarray], tf: list[np.ndarray], factor: np.ndarray, wanted: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(items, int64 scores by document and item) for some documents, in tiles of them."""
    cuts = range(0, len(at), DOC_TILE)
    entries = []
    for i in cuts:
        rows = np.repeat(np.arange(len(at[i : i + DOC_TILE])), [len(x) for x in at[i : i + DOC_TILE]])
        times = np.concatenate(tf[i : i + DOC_TILE]).astype(np.int64)
        impact = (1_000_000_000 * times) // (1000 * times + 8 * factor[i : i + DOC_TILE][rows])
        entries.append((rows, np.concatenate(at[i : i + DOC_TILE]), impact.astype(float)))
    column = np.full(size, -1, np.int64)
    items, scores = None, np.zeros((0, 0), np.int64)
    for of, vocabulary, weights in wanted:
        if items is None or of[0] != items[0]:
            if items is not None:
                yield items, scores
            items, scores = of, np.zeros((len(at), len(of)), np.int64)
        column[vocabulary] = np.arange(len(vocabulary))
        for i, (rows, place, impact) in zip(cuts, entries, strict=True):
            own = column[place]
            mine = own >= 0
            dense = np.zeros((len(at[i : i + DOC_TILE]), len(vocabulary)))
            dense[rows[mine], own[mine]] = impact[mine]
            scores[i : i + DOC_TILE] += (dense @ weights).astype(np.int64)
        column[vocabulary] = -1
    if items is not None:
        yield items, scores


def score_documents(postings: DataFrame, item: np.ndarray, term: np.ndarray, weight: np.ndarray, size: int, n_docs: int, occurrences: int, k: int) -> DataFrame:
    """item (number in the round), doc_id, score: the best ``k`` documents of each item in each task.

    ``item, term, weight`` are the round's entries, sorted by item.
    """
    plain = tuple(x.astype(np.int64).tobytes() for x in (item, term, weight))
    shared = postings.sparkSession.sparkContext.broadcast(plain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [np.frombuffer(x, np.int64) for x in shared.value]
        best = Best(k)
        for b in batches:
            if not b.num_rows:
                continue
            n = b.column(1).to_numpy(zero_copy_only=False)
            doc = b.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            no_id = b.column(0).is_null().to_numpy(zero_copy_only=False)
            at = [np.frombuffer(x, np.int32) for x in b.column(2).to_pylist()]
            tf = [np.frombuffer(x, np.int32) for x in b.column(3).to_pylist()]
            for items, scores in tile_scores(at, tf, length_factor(n, n_docs, occurrences), tiles(*own), size):
                best.offer(items, scores, doc, no_id)
        yield best.batch()

    return postings.where("octet_length(at) > 0").select("doc_id", "n", "at", "tf").mapInArrow(run, "item long, doc_id long, score long")


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    """The best ``k`` rows of each item, ranked: first within salted groups, then over what is left of them."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    some = salted.withColumn("r", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).where(F.col("r") <= k).drop("r", "salt")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = TOP, round_pairs: int = ROUND_PAIRS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's ``k`` best documents of score above 0."""
    spark = docs.sparkSession
    own: list[str] = []
    rows = columns_of(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    terms = materialize(item_terms(items), "item_terms", own)
    rounds = max(1, -(-terms.count() // round_pairs))
    found: DataFrame | None = None
    kept: list[str] = []
    for r in range(rounds):
        part = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(rounds)) == r)
        entries = part.toArrow()
        ids = entries.column("item_id").combine_chunks()
        names = ids.unique()
        number = ids.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
        vocabulary, term = np.unique(entries.column("term").to_numpy().view(np.uint64), return_inverse=True)
        stage: list[str] = []
        postings = materialize(count_terms(rows, vocabulary), "postings", stage)
        n_docs, occurrences = postings.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = document_frequencies(postings, len(vocabulary)) if n_docs else np.zeros(len(vocabulary), np.int64)
        by_term = np.array([term_weight(n_docs, int(d)) for d in df], np.int64)
        order = np.argsort(number, kind="stable")
        times = entries.column("times").to_numpy()
        best = score_documents(postings, number[order], term[order], (by_term[term] * times)[order], len(vocabulary), n_docs, max(occurrences, 1), k)
        ids_of = spark.createDataFrame(pa.table({"item": pa.array(np.arange(len(names))), "item_id": names}), f"item long, item_id {terms.schema['item_id'].dataType.simpleString()}")
        ranked = materialize(_ranked(best, k).join(ids_of, "item").select("item_id", "rank", "doc_id", "score"), "ranked", kept)
        remove_written(spark, stage)
        found = ranked if found is None else found.unionByName(ranked)
    remove_written(spark, own)
    return found
