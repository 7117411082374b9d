"""Language identification with interpolated Kneser-Ney character models.

One character n-gram model per language is estimated from a bounded,
hash-chosen sample of labelled documents (``sample_docs`` per language, a
parameter).  The models of all languages share sorted arrays of 64-bit
n-gram hashes, one array per order, with a column of interpolated log
probabilities per language; contexts have their own arrays of back-off
weights.  Scoring hashes every window of a whole text, looks the hashes up
by binary search and backs off only where no language has seen the n-gram.
The language of lowest length-normalised cross-entropy wins.

Rejection is calibrated on other labelled documents: a text is rejected
when its cross-entropy exceeds the language's mean by more standard errors
(for its length) than calibration texts show, with a margin.  The score is a
softmax over negative cross-entropies whose sharpness is fitted there too.

Letters only: a text is lower-cased and every run of other characters
becomes one space, so markup, digits and symbols neither help nor harm.

Defined cases: null text and text without a letter is ``und``, score 0,
rejected; with no labelled documents nothing is learned, every text is
``und`` with score 0 and only texts without letters are rejected; ties go
to the alphabetically first language; rows without an id are never learned
from and are not held out.  A value of ``lang`` has a model if at least one in
``MAX_LANGUAGES`` of the labelled documents carries it, which keeps typing
errors and free text out and the number of models bounded; documents of other
labels are scored like all others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.llm.common import code_points, columns_of, mix64, pinned, shipped, slices, unpacked
from shelfwise.plans.materialize import materialize, remove_written

ORDER = 5
SAMPLE_DOCS = 1200
CALIBRATION_DOCS = 400
MAX_LANGUAGES = 1000
SPACE = 32
SLICE_CHARS = 500_000
UNKNOWN = "und"


def letter_map() -> np.ndarray:
    """Lower-case letter of each code point of the basic plane, or a space."""
    out = np.full(65536, SPACE, np.uint32)
    for i in range(65536):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def letters_only(texts: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, ends, letter counts): each text as ORDER-1 spaces, then words, each followed by one space."""
    codes, ends = code_points([" " + t + " " for t in texts])
    m = letters[np.minimum(codes, 65535)]
    for i in np.flatnonzero(codes > 65535):
        m[i] = codes[i] if chr(codes[i]).isalpha() else SPACE
    starts = np.concatenate([[0], ends[:-1]])
    solid = m != SPACE
    keep = solid.copy()
    keep[1:] |= solid[:-1]
    keep[starts] = True
    kept_before = np.concatenate([[0], np.cumsum(keep)])
    new_ends, new_starts = kept_before[ends], kept_before[starts]
    pad = ORDER - 2
    out = np.full(int(new_ends[-1]) + pad * len(texts), SPACE, np.uint32)
    kept = m[keep]
    for i, (a, b) in enumerate(zip(new_starts.tolist(), new_ends.tolist(), strict=True), 1):
        out[a + pad * i : b + pad * i] = kept[a:b]
    n_letters = np.add.reduceat(solid, starts, dtype=np.int64)
    return out, new_ends + pad * np.arange(1, len(texts) + 1), n_letters


def hashes(windows: list[np.ndarray]) -> np.ndarray:
    """One hash per n-gram, given its characters by position (first character first)."""
    h = np.full(len(windows[0]), np.uint64(len(windows)), np.uint64)
    for w in windows:
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += w
        h ^= h >> np.uint64(29)
    return mix64(h)


class HashArray:
    """Sorted 64-bit hashes, with where each value of their leading bits begins: a lookup starts next to its place."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = np.append(keys, np.uint64(2**64 - 1))  # a sentinel: every lookup has a next key
        self.size = len(keys)
        bits = max(4, min(20, int(self.size).bit_length() + 1))
        self.shift = np.uint64(64 - bits)
        self.starts = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, found) of each wanted hash; indices are only of use where found."""
        at = self.starts[(wanted >> self.shift).view(np.int64)]
        here = self.keys[at]
        late = np.flatnonzero(here < wanted)
        while len(late):
            at[late] += 1
            here[late] = self.keys[at[late]]
            late = late[here[late] < wanted[late]]
        return at, (here == wanted) & (at < self.size)


@dataclass
class Model:
    langs: list[str]
    letters: np.ndarray
    keys: list[HashArray] = field(default_factory=list)  # n-gram hashes by order
    logp: list[np.ndarray] = field(default_factory=list)  # log probability by n-gram and language
    ctx: list[HashArray] = field(default_factory=list)  # context hashes by order
    back: list[np.ndarray] = field(default_factory=list)  # log back-off weight by context and language
    unseen: np.ndarray = field(default_factory=lambda: np.zeros(0))
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))  # calibration, by language
    spread: np.ndarray = field(default_factory=lambda: np.zeros(0))
    noise: np.ndarray = field(default_factory=lambda: np.zeros(0))
    limit: np.ndarray = field(default_factory=lambda: np.zeros(0))
    sharpness: float = 1.0

    def log_probabilities(self, windows: list[np.ndarray], order: int = ORDER) -> np.ndarray:
        """log p(last character | the others) by window and language.

        Rows past the known n-grams of ``logp`` and ``back`` are neutral, so that a miss reads a defined value.
        """
        grams = windows[-order:]
        at, found = self.keys[order - 1].find(hashes(grams))
        out = self.logp[order - 1][at]
        miss = np.flatnonzero(~found)
        if len(miss):
            if order == 1:
                out[miss] = self.unseen
            else:
                lower = [w[miss] for w in grams]
                at, known = self.ctx[order - 1].find(hashes(lower[:-1]))
                out[miss] = np.where(known[:, None], self.back[order - 1][at], 0) + self.log_probabilities(lower[1:], order - 1)
        return out

    def entropies(self, texts: list[str], variance: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text: cross-entropy (nats a character) by language, its variance a character (if asked for), letters."""
        ce, var = np.zeros((len(texts), len(self.langs))), np.zeros((len(texts), len(self.langs)))
        count = np.zeros(len(texts), np.int64)
        for a, b in slices([len(t) + 16 for t in texts], SLICE_CHARS):
            sym, ends, count[a:b] = letters_only(texts[a:b], self.letters)
            # window i ends at symbol i + ORDER - 1: a text's windows run from its start to its end less ORDER - 1
            starts = np.concatenate([[0], ends[:-1]])
            n = ends - starts - (ORDER - 1)
            width = len(sym) - ORDER + 1
            lp = self.log_probabilities([sym[k : k + width] for k in range(ORDER)])
            # windows across two texts are left out: their rows stand between a text's end and the next start
            cuts = np.stack([starts, starts + n], 1).ravel()
            total = lambda x: np.add.reduceat(x, cuts, axis=0, dtype=np.float64)[::2]
            last = np.append(lp, np.zeros((1, lp.shape[1]), lp.dtype), axis=0)
            some = np.maximum(n, 1)[:, None]
            s1 = np.where(n[:, None] > 0, total(last), 0) / some
            ce[a:b] = -s1
            if variance:
                var[a:b] = np.maximum(np.where(n[:, None] > 0, total(last * last), 0) / some - s1 * s1, 0)
        return ce, var, count

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(language, score, cross-entropy, rejected) of each text."""
        clean = [t or "" for t in texts]
        if not self.langs:
            none = np.array([not any(c.isalpha() for c in t) for t in clean], bool)
            return [UNKNOWN] * len(clean), np.zeros(len(clean)), np.zeros(len(clean)), none
        ce, _, count = self.entropies(clean)
        best = ce.argmin(1)
        rows = np.arange(len(clean))
        low = ce[rows, best] if len(clean) else np.zeros(0)
        score = 1 / np.exp(-self.sharpness * (ce - low[:, None])).sum(1)
        error = np.sqrt(self.spread[best] ** 2 + self.noise[best] / np.maximum(count, 1))
        none = count == 0
        rejected = none | (low > self.mean[best] + self.limit[best] * error)
        return [UNKNOWN if x else self.langs[j] for x, j in zip(none, best, strict=True)], np.where(none, 0.0, score), np.where(none, 0.0, low), rejected


def _codes(grams: list[str]) -> np.ndarray:
    return np.array([[ord(c) for c in g] for g in grams], np.uint32).reshape(len(grams), -1)


def _columns(m: np.ndarray) -> list[np.ndarray]:
    return [np.ascontiguousarray(m[:, i]) for i in range(m.shape[1])]


def _with_neutral(x: np.ndarray) -> np.ndarray:
    """Single precision, with a row of zeros for the sentinel of a hash array."""
    return np.append(x, np.zeros((1, x.shape[1])), axis=0).astype(np.float32)


def kneser_ney(counts: dict[str, dict[str, int]], letters: np.ndarray) -> Model:
    """The joint model from each language's counts of ORDER-grams."""
    langs = sorted(counts)
    model = Model(langs, letters, keys=[], logp=[], ctx=[], back=[])
    alphabet = {c for g in counts.values() for x in g for c in x}
    vocabulary = len(alphabet) + 1
    # counts by order: occurrences at the top, distinct left neighbours below
    tables: list[list[dict[str, int]]] = [[{} for _ in langs] for _ in range(ORDER + 1)]
    for j, lang in enumerate(langs):
        tables[ORDER][j] = counts[lang]
        for n in range(ORDER - 1, 0, -1):
            below: dict[str, int] = {}
            for g in tables[n + 1][j]:
                below[g[1:]] = below.get(g[1:], 0) + 1
            tables[n][j] = below
    previous: dict[str, np.ndarray] = {}
    for n in range(1, ORDER + 1):
        union = sorted(set().union(*tables[n]))
        p = np.zeros((len(union), len(langs)))
        contexts = sorted({g[:-1] for g in union})
        at_ctx = {c: i for i, c in enumerate(contexts)}
        weight = np.ones((len(contexts), len(langs)))
        unseen = np.zeros(len(langs))
        ctx_of = np.array([at_ctx[g[:-1]] for g in union], np.int64)
        for j in range(len(langs)):
            c = np.array([tables[n][j].get(g, 0) for g in union], float)
            n1, n2 = (c == 1).sum(), (c == 2).sum()
            d = min(max(n1 / (n1 + 2 * n2), 0.1), 0.95) if n1 and n2 else 0.5
            total = np.bincount(ctx_of, c, len(contexts))
            types = np.bincount(ctx_of, c > 0, len(contexts))
            seen = total > 0
            weight[seen, j] = d * types[seen] / total[seen]
            lower = np.full(len(union), 1 / vocabulary) if n == 1 else np.array([previous[g[1:]][j] for g in union])
            own = np.divide(np.maximum(c - d, 0), total[ctx_of], out=np.zeros(len(c)), where=total[ctx_of] > 0)
            p[:, j] = own + weight[ctx_of, j] * lower
            unseen[j] = weight[0, j] / vocabulary if len(contexts) else 1 / vocabulary
        previous = dict(zip(union, p, strict=True))
        if n == 1:
            model.unseen = np.log(unseen).astype(np.float32)
        key = hashes(_columns(_codes(union)))
        order = np.argsort(key)
        model.keys.append(HashArray(key[order]))
        model.logp.append(_with_neutral(np.log(p[order])))
        key = hashes(_columns(_codes(contexts))) if n > 1 else np.zeros(0, np.uint64)
        order = np.argsort(key)
        model.ctx.append(HashArray(key[order]))
        model.back.append(_with_neutral(np.log(weight[order])))
    return model


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def _fold(docs: DataFrame) -> DataFrame:
    """Documents that may be learned from, with ``draw``: a seeded uniform number."""
    draw = F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return docs.where("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL").where(~held_out()).withColumn("draw", draw)


def _share(sizes: dict[str, int], wanted: int) -> Column:
    """The share of each language's documents that gives about ``wanted`` of them."""
    pairs = [x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, wanted / n)))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("lang")), F.lit(0.0))


def count_grams(docs: DataFrame, letters: np.ndarray) -> DataFrame:
    """lang, gram, n over the given documents' whole texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lang in sorted(set(langs)):
                own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
                for i, j in slices([len(t) for t in own], SLICE_CHARS):
                    sym, ends, _ = letters_only(own[i:j], letters)
                    valid = np.ones(max(len(sym) - ORDER + 1, 0), bool)
                    for k in range(1, ORDER):
                        cut = ends[:-1] - k
                        valid[cut[(cut >= 0) & (cut < len(valid))]] = False
                    at = np.flatnonzero(valid)
                    windows = [sym[at + k] for k in range(ORDER)]
                    _, first, n = np.unique(hashes(windows), return_index=True, return_counts=True)
                    grams = ["".join(map(chr, x)) for x in np.stack([w[first] for w in windows], 1).tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.string()), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    counted = docs.select("lang", "text").mapInArrow(count, "lang string, gram string, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, calibration_docs: int = CALIBRATION_DOCS) -> Model:
    """Estimate and calibrate the models from documents with text, lang and doc_id.

    About ``sample_docs`` documents of each language are counted and
    ``calibration_docs`` others set thresholds: what reaches the driver is
    bounded by these two, whatever the corpus holds.
    """
    letters = letter_map()
    fold = _fold(columns_of(docs, doc_id="doc_id", text="text", lang="lang"))
    own: list[str] = []
    labels = materialize(fold.groupBy("lang").agg(F.count("*").alias("n")), "lang_labels", own)
    total = labels.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    sizes = {r["lang"]: r["n"] for r in labels.where(F.col("n") * MAX_LANGUAGES >= total).collect()}
    remove_written(docs.sparkSession, own)
    if not sizes:
        return Model([], letters)
    counts: dict[str, dict[str, int]] = {}
    for lang, gram, n in count_grams(fold.where(F.col("draw") < _share(sizes, sample_docs)), letters).collect():
        counts.setdefault(lang, {})[gram] = n
    if not counts:
        return Model([], letters)
    model = kneser_ney(counts, letters)
    calibrate(model, fold.where(F.col("draw") >= 1 - _share(sizes, calibration_docs)))
    return model


def calibrate(model: Model, docs: DataFrame) -> None:
    """Set each language's rejection limit and the sharpness of scores from labelled documents."""
    shared = shipped(docs.sparkSession, model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = unpacked(shared)
        at = {x: j for j, x in enumerate(m.langs)}
        for b in batches:
            true = [at.get(x, -1) for x in b.column(0).to_pylist()]
            ce, var, n = m.entropies(b.column(1).to_pylist(), variance=True)
            rows = [(t, e.tolist(), float(v[t]), int(k)) for t, e, v, k in zip(true, ce, var, n, strict=True) if t >= 0 and k]
            cols = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.list_(pa.float64())), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.int64())], ["t", "ce", "var", "n"])

    rows = docs.select("lang", "text").mapInArrow(measure, "t int, ce array<double>, var double, n long").collect()
    shared.destroy()
    k = len(model.langs)
    model.mean, model.spread, model.noise, model.limit = np.full(k, 1e9), np.ones(k), np.ones(k), np.ones(k)
    if not rows:
        return
    t = np.array([r["t"] for r in rows])
    ce = np.array([r["ce"] for r in rows])
    var, n = np.array([r["var"] for r in rows]), np.array([r["n"] for r in rows], float)
    own = ce[np.arange(len(t)), t]
    for j in range(k):
        mine = t == j
        if not mine.any():
            continue
        model.mean[j] = np.median(own[mine])
        model.noise[j] = var[mine].mean()
        # spread beyond what length explains, but never below a tenth of the mean
        model.spread[j] = max(0.1 * model.mean[j], math.sqrt(max(0.0, np.var(own[mine]) - (var[mine] / n[mine]).mean())))
        z = (own[mine] - model.mean[j]) / np.sqrt(model.spread[j] ** 2 + model.noise[j] / n[mine])
        model.limit[j] = 3.0 + 1.25 * max(float(z.max()), 4.0)
    low = ce - own[:, None]
    model.sharpness = min((2.0**e for e in range(-2, 8)), key=lambda s: float(np.log(np.exp(np.minimum(-s * low, 700)).sum(1)).mean()))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` with lang_pred, score, cross_entropy and rejected appended."""
    inner, (text,) = pinned(docs, "text")
    shared = shipped(docs.sparkSession, model)
    at = inner.columns.index(text)
    schema = T.StructType([*inner.schema.fields, *T.StructType.fromDDL("p_lang string, p_score double, p_entropy double, p_rejected boolean").fields])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = unpacked(shared)
        for b in batches:
            lang, score, entropy, rejected = m.predict(b.column(at).to_pylist())
            more = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(entropy, pa.float64()), pa.array(rejected.astype(bool))]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, "p_lang", "p_score", "p_entropy", "p_rejected"])

    return inner.mapInArrow(predict, schema).toDF(*docs.columns, "lang_pred", "score", "cross_entropy", "rejected")


def language_report(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, calibration_docs: int = CALIBRATION_DOCS) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, cross_entropy, rejected."""
    model = fit(docs, sample_docs, calibration_docs)
    rows = identify(columns_of(docs, doc_id="doc_id", text="text"), model)
    return rows.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def language_filter(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, calibration_docs: int = CALIBRATION_DOCS) -> DataFrame:
    """The documents whose language is recognised, with their own columns."""
    model = fit(docs, sample_docs, calibration_docs)
    inner, (text,) = pinned(docs, "text")
    rows = identify(inner.withColumnRenamed(text, "text"), model)
    return rows.where("NOT rejected").select(*rows.columns[: len(docs.columns)]).toDF(*docs.columns)
