"""Quality classifier: random-indexing word vectors pooled per document, and a small network over them.

Each word of the model's vocabulary has a random index vector - a few +1 and -1
entries, drawn by a hash of the word - and a context vector: the sum of the
index vectors of the words around it, over all its occurrences in the fitted
documents, scaled to unit length.  A document is pooled to the mean of its
words' context vectors, their deviation and the mean of their index vectors.  A
network of two layers (numpy) turns that into a logit, and a temperature
fitted on documents of its own turns the logit into a probability.

Words are letter runs (in lower case), numbers, runs of other marks and line
ends.  A word outside the vocabulary stands for its shape (case and length).  Case,
and a word that repeats the one before it, count as words of their own.

The model is fitted on a bounded sample, drawn by a seeded hash of the id:
``fit_docs`` labelled documents (their whole texts) and ``calibration_docs``
others; the vocabulary is the ``max_words`` most frequent words of the former.
What reaches the driver and what is broadcast is bounded by these three
numbers.  Every document is scored, over its whole text, from its text alone.

Defined cases: null text counts as empty; an empty text is scored from its
length alone (all pooled entries are zero); rows that share an id are scored
each for itself; an id with both labels teaches nothing; without labels of
both kinds every score is the share of label 1 (0.5 without any label).
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import columns_of, mix64
from shelfwise.plans.materialize import materialize, remove_written

FIT_DOCS = 6000
CALIBRATION_DOCS = 2000
MAX_WORDS = 20_000
FIT_TASKS = 8  # tasks that send a context matrix each
LEAST_DOCS = 3  # documents of the sample that a word of the vocabulary is in
DIMENSIONS = 64
ENTRIES = 6  # of an index vector that are not zero
WINDOW = 2
HIDDEN = 32
EPOCHS = 60
PREDICT_AT = 0.7

TOKEN = re.compile(r"[^\W\d_]+|\d+|\n|(?:[^\w\s]|_)+")
SHAPES = [f"<{case}{n}>" for case in "laum" for n in range(1, 6)] + ["<number>", "<marks>"]
MARKERS = ["<again>", "<upper>", "<title>"]
SEPARATOR = "\x1c"  # white space, so in no token


def shape(token: str) -> str:
    """The class of a word that is not in the vocabulary."""
    if token.isdigit():
        return "<number>"
    if not token[0].isalpha():
        return "<marks>"
    case = "l" if token.islower() else "u" if token.isupper() else "a" if token.istitle() else "m"
    return f"<{case}{min(5, (len(token) + 2) // 3)}>"


def index_vectors(words: list[str]) -> np.ndarray:
    """Each word's sparse random vector, by a hash of the word alone."""
    out = np.zeros((len(words), DIMENSIONS), np.float32)
    names = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words], np.uint64)
    rows = np.arange(len(words))
    for k in range(ENTRIES):
        draw = mix64(names * np.uint64(ENTRIES) + np.uint64(k + 61))
        np.add.at(out, (rows, (draw % np.uint64(DIMENSIONS)).astype(np.int64)), np.float32(1 - 2 * (k % 2)))
    return out


def token_ids(tokens: list[str], at: dict[str, int]) -> np.ndarray:
    """Tokens as vocabulary positions."""
    return np.fromiter((at[low] if (low := t.lower()) in at else at[shape(t)] for t in tokens), np.int64, len(tokens))


class Pooling:
    """Turns texts into features: the vocabulary with its vectors, and the tokens met so far."""

    MEMO = 300_000  # tokens whose position is remembered

    def __init__(self, words: list[str], context: np.ndarray) -> None:
        self.at = {w: i for i, w in enumerate(words)}
        self.vectors = np.concatenate([context, context**2, index_vectors(words)], axis=1)
        self.memo: dict[str, tuple[int, int]] = {}

    def positions(self, token: str) -> tuple[int, int]:
        """The token's position and that of the marker of its case (-1: none)."""
        found = self.memo.get(token)
        if found is None:
            if len(self.memo) >= self.MEMO:
                self.memo.clear()
            low, marker = token.lower(), ""
            if token != low:
                marker = "<upper>" if token.isupper() and len(token) > 1 else "<title>" if token.istitle() else ""
            found = self.at[low] if low in self.at else self.at[shape(token)], self.at[marker] if marker else -1
            if len(token) <= 64:
                self.memo[token] = found
        return found

    def counts(self, text: str) -> dict[int, int]:
        """Vocabulary positions with their counts: of the text's words, shapes and markers."""
        tokens = TOKEN.findall(text)
        out: dict[int, int] = {}
        for token, n in Counter(tokens).items():
            for i in self.positions(token):
                if i >= 0:
                    out[i] = out.get(i, 0) + n
        again = sum(map(eq, tokens, tokens[1:]))
        if again:
            out[self.at["<again>"]] = again
        return out

    def features(self, texts: list[str | None]) -> np.ndarray:
        """One row of features for each text."""
        out = np.zeros((len(texts), 3 * DIMENSIONS + 1))
        for i, text in enumerate(texts):
            counts = self.counts(text or "")
            n = np.fromiter(counts.values(), np.float32, len(counts))
            total = n.sum(dtype=float)
            out[i, -1] = np.log1p(total)
            if total:
                out[i, :-1] = n @ self.vectors[np.fromiter(counts, np.int64, len(counts))] / total
        mean, square = out[:, :DIMENSIONS], out[:, DIMENSIONS : 2 * DIMENSIONS]
        np.sqrt(np.maximum(square - mean**2, 0), out=square)
        return out


@dataclass
class Network:
    """Two layers over standardised features; ``temperature`` divides the logit."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))

    def arrays(self) -> tuple:
        """The network as plain numbers and bytes."""
        return tuple(x.tobytes() for x in (self.mean, self.scale, self.w1, self.b1, self.w2)) + (self.b2, self.temperature)


def network_of(arrays: tuple) -> Network:
    mean, scale, w1, b1, w2 = (np.frombuffer(x) for x in arrays[:5])
    return Network(mean, scale, w1.reshape(len(mean), len(b1)), b1, w2, *arrays[5:])


def train(x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 62) -> Network:
    """Adam on the mean log loss with weight decay; the same rows give the same network."""
    g = np.random.Generator(np.random.PCG64(seed))
    spread = x.std(axis=0)
    # a feature that hardly varies must not be blown up
    net = Network(x.mean(axis=0), np.maximum(spread, 1e-3 * max(spread.max(), 1e-9) + 1e-9), g.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), g.normal(0, HIDDEN**-0.5, HIDDEN), 0.0)
    z = np.clip((x - net.mean) / net.scale, -10, 10)
    values = [net.w1, net.b1, net.w2, np.zeros(1)]
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    steps, size = 0, 64
    for epoch in range(epochs):
        rate = 0.003 * (1 - epoch / epochs)
        order = g.permutation(len(z))
        for start in range(0, len(z), size):
            rows = order[start : start + size]
            hidden = np.tanh(z[rows] @ values[0] + values[1])
            error = (1 / (1 + np.exp(-np.clip(hidden @ values[2] + values[3], -50, 50))) - y[rows]) / len(rows)
            back = np.outer(error, values[2]) * (1 - hidden**2)
            slopes = [z[rows].T @ back + 1e-3 * values[0], back.sum(axis=0), hidden.T @ error + 1e-3 * values[2], error.sum(keepdims=True)]
            steps += 1
            for v, m, s, d in zip(values, first, second, slopes, strict=True):
                m += 0.1 * (d - m)
                s += 0.001 * (d * d - s)
                v -= rate * (m / (1 - 0.9**steps)) / (np.sqrt(s / (1 - 0.999**steps)) + 1e-8)
    net.b2 = float(values[3][0])
    return net


def calibrate(net: Network, x: np.ndarray, y: np.ndarray) -> None:
    """The temperature of least log loss on rows that the network was not trained on."""
    if not len(y):
        return
    logits = net.logits(x)

    def loss(t: float) -> float:
        return float(np.logaddexp(0, np.where(y > 0, -logits, logits) / t).mean())

    net.temperature = min((2.0 ** (e / 4) for e in range(-8, 25)), key=loss)


# ---- fitting ----------------------------------------------------------------
def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, fit_docs: int, calibration_docs: int, written: list[str]) -> DataFrame:
    """quality, fit (else calibration), text of about the wanted numbers of documents that may be learned from, as a written table."""
    known = columns_of(labels, label_id="doc_id", quality="quality").where("label_id IS NOT NULL AND quality IN (0, 1)").where(~held_out("label_id"))
    one = known.groupBy("label_id").agg(F.min("quality").cast("int").alias("quality"), F.max("quality").alias("other")).where("quality = other").drop("other")
    one = materialize(one.withColumn("draw", F.pmod(F.xxhash64(F.lit(63), "label_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))), "labels", written)
    share = min(1.0, (fit_docs + calibration_docs) / max(one.count(), 1))
    fit = F.col("draw") < share * fit_docs / (fit_docs + calibration_docs)
    drawn = materialize(one.where(F.col("draw") < share).select("label_id", "quality", fit.alias("fit")), "drawn_labels", written)
    return materialize(docs.join(drawn, F.col("doc_id") == F.col("label_id")).select("quality", "fit", F.coalesce("text", F.lit("")).alias("text")), "fit_sample", written)


def vocabulary_of(sample: DataFrame, max_words: int) -> list[str]:
    """The most frequent words of the fitted documents, then shapes and markers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: Counter = Counter()
            for text in b.column(0).to_pylist():
                seen.update({t.lower() for t in TOKEN.findall(text)})
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "docs"])

    seen = sample.select("text").mapInArrow(run, "word string, docs long").groupBy("word").agg(F.sum("docs").alias("docs"))
    top = seen.where(f"docs >= {LEAST_DOCS} AND length(word) <= 64").orderBy(F.desc("docs"), "word").limit(max_words)
    return [r["word"] for r in top.select("word").collect()] + SHAPES + MARKERS


def context_vectors(sample: DataFrame, words: list[str]) -> np.ndarray:
    """Each word's context vector, of unit length (zero for a word without neighbours)."""
    shared = sample.sparkSession.sparkContext.broadcast(SEPARATOR.join(words).encode("utf-8", "surrogatepass"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value.decode("utf-8", "surrogatepass").split(SEPARATOR)
        at, index = {w: i for i, w in enumerate(known)}, index_vectors(known).astype(np.int32)
        sums = np.zeros((len(known), DIMENSIONS), np.int32)
        for b in batches:
            for text in b.column(0).to_pylist():
                ids = token_ids(TOKEN.findall(text), at)
                for k in range(1, WINDOW + 1):
                    pairs, n = np.unique(ids[:-k] * len(known) + ids[k:], return_counts=True)
                    left, right = np.divmod(pairs, len(known))
                    np.add.at(sums, left, index[right] * n[:, None].astype(np.int32))
                    np.add.at(sums, right, index[left] * n[:, None].astype(np.int32))
        met = np.flatnonzero(np.abs(sums).sum(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array([x.tobytes() for x in sums[met]], pa.binary())], ["at", "sums"])

    out = np.zeros((len(words), DIMENSIONS))
    rows = sample.select("text").repartition(FIT_TASKS).mapInArrow(run, "at long, sums binary").toArrow()
    np.add.at(out, rows.column("at").to_numpy(), np.frombuffer(b"".join(rows.column("sums").to_pylist()), np.int32).reshape(-1, DIMENSIONS))
    shared.destroy()
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def _pool(rows: DataFrame, model: tuple, keep: list[str], schema: str, score: bool) -> DataFrame:
    """``keep`` columns of ``rows`` (the last column is the text) with the pooled features, or with the score."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, vectors, arrays = shared.value
        known = names.decode("utf-8", "surrogatepass").split(SEPARATOR)
        pooling = Pooling(known, np.frombuffer(vectors, np.float32).reshape(len(known), DIMENSIONS))
        net = network_of(arrays) if score else None
        for b in batches:
            x = pooling.features(b.column(len(keep)).to_pylist())
            last = pa.array(net.scores(x)) if score else pa.array([v.tobytes() for v in x], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], last], [*keep, "out"])

    return rows.select(*keep, "text").mapInArrow(run, schema)


@dataclass
class QualityModel:
    """What scoring needs, as plain data: the vocabulary, context vectors and the network (None: ``share`` is the score)."""

    plain: tuple | None
    share: float


def fit(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS, calibration_docs: int = CALIBRATION_DOCS, max_words: int = MAX_WORDS) -> QualityModel:
    """Fit vectors, network and temperature on a bounded labelled sample."""
    own: list[str] = []
    spark = docs.sparkSession
    sample = labelled_sample(columns_of(docs, doc_id="doc_id", text="text"), labels, fit_docs, calibration_docs, own)
    taught = sample.where("fit")
    n, good = taught.agg(F.count("*"), F.coalesce(F.sum("quality"), F.lit(0))).first()
    if not 0 < good < n:
        remove_written(spark, own)
        return QualityModel(None, good / n if n else 0.5)
    words = vocabulary_of(taught, max_words)
    context = context_vectors(taught, words).astype(np.float32)
    names = SEPARATOR.join(words).encode("utf-8", "surrogatepass")
    rows = _pool(sample, (names, context.tobytes(), ()), ["quality", "fit"], "quality int, fit boolean, out binary", False).toArrow()
    x = np.frombuffer(b"".join(rows.column("out").to_pylist())).reshape(-1, 3 * DIMENSIONS + 1)
    y, mine = rows.column("quality").to_numpy().astype(float), rows.column("fit").to_numpy().astype(bool)
    # in an order of their own, so that the network doesn't depend on the tasks'
    order = np.lexsort((*x.T[::-1], y))
    x, y, mine = x[order], y[order], mine[order]
    net = train(x[mine], y[mine])
    calibrate(net, x[~mine], y[~mine])
    remove_written(spark, own)
    return QualityModel((names, context.tobytes(), net.arrays()), good / n)


def quality_scores(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS, calibration_docs: int = CALIBRATION_DOCS, max_words: int = MAX_WORDS) -> DataFrame:
    """Per document: doc_id, held_out, score (probability of label 1), predicted (1 from 0.7)."""
    model = fit(docs, labels, fit_docs, calibration_docs, max_words)
    rows = columns_of(docs, doc_id="doc_id", text="text")
    if model.plain is None:
        scored = rows.select("doc_id", F.lit(model.share).alias("out"))
    else:
        scored = _pool(rows, model.plain, ["doc_id"], f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, out double", True)
    return scored.select("doc_id", held_out().alias("held_out"), F.col("out").alias("score"), (F.col("out") >= PREDICT_AT).cast("int").alias("predicted"))
