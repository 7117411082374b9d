"""Document fingerprints by locally consistent parsing.

A text is parsed into phrases in levels.  On each level runs of one symbol
are named first, so neighbours differ; deterministic coin tossing then
labels every symbol by the lowest bit in which it differs from its left
neighbour, three times over, which leaves labels below 8; phrases start at
local maxima of the labels.  A phrase's name is a hash of its symbols, and
names are the next level's symbols.  Where a phrase begins depends only on
a few symbols around it, so equal substrings get equal phrases - and equal
names on every level - except near their ends, wherever they stand.

The fingerprint is the sorted 64 smallest 32-bit phrase names of levels 2
and 3 (about 6 and 16 characters), base64 as text, where the n-th occurrence
of a phrase in a text is a name of its own; the likeness of two fingerprints
estimates the Jaccard similarity of the texts' phrase multisets.

Defined cases: null counts as empty, whose fingerprint is "" (like itself 1,
like anything else 0); a text of one symbol is one phrase on every level.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import code_points, columns_of, mix64, slices

SIZE = 64
LEVELS = (2, 3)
SLICE_CHARS = 400_000
BUCKET_ROWS = 4096
MOST_BUCKETS = 16_384
SAMPLED = 32
POWERS = mix64(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
HALF = np.uint64(0xFFFFFFFF)
CODE_NAMES = mix64(np.arange(1, 65537, dtype=np.uint64))


def _toss_table(bits: int) -> np.ndarray:
    """The next label of a label, by (label << bits) | left neighbour's label; equal ones count as differing in the top bit."""
    own, left = np.divmod(np.arange(1 << 2 * bits), 1 << bits)
    diff = (own ^ left) | (1 << (bits - 1)) * (own == left)
    k = np.log2(diff & -diff).astype(np.int64)
    return (2 * k + ((own >> k) & 1)).astype(np.uint8)


SECOND, THIRD = _toss_table(6), _toss_table(4)


def _name_runs(sym: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each maximal run of a symbol as one symbol."""
    first = np.ones(len(sym), bool)
    first[1:] = sym[1:] != sym[:-1]
    first[ends[:-1]] = True
    if first.all():
        return sym, ends
    at = np.flatnonzero(first)
    length = np.diff(np.append(at, len(sym)))
    out = sym[at]
    runs = np.flatnonzero(length > 1)
    out[runs] = mix64(out[runs] + length[runs].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return out, np.searchsorted(at, ends)


def _toss(sym: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Labels below 8; neighbours of one text differ, but for the symbols right at its start."""
    low = sym.astype(np.uint32)
    diff = low.copy()
    diff[1:] ^= low[:-1]
    diff[starts] = 1
    diff &= (~diff) + np.uint32(1)
    # the exponent of a power of two as a float is its bit's number; no bit at all (equal low halves) counts as bit 31
    bit = diff.astype(np.float32).view(np.uint32)
    bit >>= np.uint32(23)
    bit -= np.uint32(127)
    np.minimum(bit, np.uint32(31), out=bit)
    low >>= bit
    low &= np.uint32(1)
    low |= bit << np.uint32(1)
    for bits, table in ((6, SECOND), (4, THIRD)):
        pair = low << np.uint32(bits)
        pair[1:] |= low[:-1]
        pair[starts] = (low[starts] << np.uint32(bits)) | (low[starts] ^ np.uint32(1))
        low = table[pair].astype(np.uint32) if bits == 6 else table[pair]
    return low


def next_level(sym: np.ndarray, ends: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of each text, and where each text ends among them."""
    sym, ends = _name_runs(sym, ends)
    starts = np.concatenate([[0], ends[:-1]])
    label = _toss(sym, starts)
    begins = np.zeros(len(sym), bool)
    begins[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
    # a text's last symbol never starts a phrase of its own, its first always starts one
    begins[ends - 1] = False
    begins[starts] = True
    at = np.flatnonzero(begins)
    length = np.diff(np.append(at, len(sym)))
    place = np.arange(len(sym)) - np.repeat(at, length)
    names = np.add.reduceat(sym * POWERS[place & 63], at)
    names += length.astype(np.uint64) * np.uint64(0xA0761D6478BD642F) + np.uint64(level)
    return mix64(names), np.searchsorted(at, ends)


def phrase_names(texts: list[str], levels: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(names, ends) of every level from 1 on; the texts must not be empty."""
    codes, ends = code_points(texts)
    sym = CODE_NAMES[np.minimum(codes, 65535)]
    for i in np.flatnonzero(codes > 65535):
        sym[i] = mix64(codes[i : i + 1].astype(np.uint64) + np.uint64(1))[0]
    out = []
    for level in range(1, levels + 1):
        sym, ends = next_level(sym, ends, level)
        out.append((sym, ends))
    return out


def sketches(texts: list[str]) -> list[np.ndarray]:
    """The sorted smallest phrase names of each text (an empty array for an empty text)."""
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
    some = [i for i, t in enumerate(texts) if t]
    for a, b in slices([len(texts[i]) for i in some], SLICE_CHARS):
        found = phrase_names([texts[i] for i in some[a:b]], max(LEVELS))
        keys = []
        for level in LEVELS:
            names, ends = found[level - 1]
            own = np.repeat(np.arange(b - a, dtype=np.uint64), np.diff(np.concatenate([[0], ends])))
            keys.append((own << np.uint64(32)) | (names >> np.uint64(32)))
        key = np.concatenate(keys)
        key.sort()
        # the n-th occurrence of a name in a text is an element of its own
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        at = np.flatnonzero(new)
        again = np.flatnonzero(~new)
        nth = (again - at[np.searchsorted(at, again, "right") - 1]).astype(np.uint64)
        key[again] = (key[again] & ~HALF) | (mix64((key[again] & HALF) + (nth << np.uint64(32))) >> np.uint64(32))
        key.sort()
        first = np.searchsorted(key, np.arange(b - a, dtype=np.uint64) << np.uint64(32)).tolist()
        low = key.astype(np.uint32)
        for i, x, y in zip(some[a:b], first, [*first[1:], len(key)], strict=True):
            out[i] = low[x : min(y, x + SIZE)]
    return out


def as_text(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype(">u4").tobytes()).decode()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity of the phrase multisets: matches among the smallest names of either."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    x, y = set(a.tolist()), set(b.tolist())
    union = sorted(x | y)[:SIZE]
    return len((x & y).intersection(union)) / len(union)


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every document."""
    rows = columns_of(docs, doc_id="doc_id", text="text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = [as_text(s) for s in sketches([t or "" for t in b.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string())], ["doc_id", "fingerprint"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def _order_key() -> Column:
    """Sorts like (doc_id with nulls first, a hash of the text, a draw): equal ids, even equal rows, can be cut apart."""
    word = lambda c: F.lpad(F.hex(c), 16, "0")
    number = F.col("doc_id").cast("long")
    from_zero = word(number.bitwiseXOR(F.shiftleft(F.lit(1).cast("long"), 63)))
    # the draw follows a row's place in its input split, so every reader of the input sees the same one
    draw = word((F.rand(47) * F.lit(float(1 << 52))).cast("long"))
    return F.concat(F.when(number.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), from_zero)), word(F.xxhash64("text")), draw)


def id_buckets(rows: DataFrame, bucket_rows: int) -> DataFrame:
    """``rows`` (doc_id, text) with ``key`` and ``bucket``: runs of the key's order, about ``bucket_rows`` rows each.

    Borders come from a sample of the keys, ``SAMPLED`` a bucket, at most
    ``MOST_BUCKETS * SAMPLED`` of them (buckets grow beyond that); they decide
    how even the buckets are, never what the result is.
    """
    keyed = rows.withColumn("key", _order_key())
    n = rows.count()
    buckets = min(MOST_BUCKETS, max(1, math.ceil(n / bucket_rows)))
    borders: list[str] = []
    if buckets > 1:
        sample = sorted(r[0] for r in keyed.select("key").where(F.rand(53) < SAMPLED * buckets / n).collect())
        borders = sorted({sample[len(sample) * i // buckets] for i in range(1, buckets)} if sample else ())
    cuts = np.array(borders, "U")

    @F.pandas_udf("long")
    def bucket(key: pd.Series) -> pd.Series:
        if not len(cuts):
            return pd.Series(np.zeros(len(key), np.int64))
        return pd.Series(np.searchsorted(cuts, key.to_numpy().astype("U"), side="right").astype(np.int64))

    return keyed.withColumn("bucket", bucket("key"))


def in_id_order(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Rows (bucket, halo, doc_id, text) so that each row's successor by doc_id follows it in its bucket.

    Buckets follow the distribution of the rows, so outlying, clustered, null
    or repeated ids make none larger; each bucket also gets the first row of
    the next one (of the first bucket, after the last), marked by ``halo``.
    Null ids come first, equal ids by a hash of their texts.  One shuffle of
    the texts; what is gathered over all rows is one key per bucket, of at
    most ``MOST_BUCKETS`` buckets.
    """
    rows = id_buckets(columns_of(docs, doc_id="doc_id", text="text"), bucket_rows)
    heads = rows.groupBy("bucket").agg(F.min("key").alias("head"))
    order = Window.orderBy("bucket")
    before = F.coalesce(F.lag("bucket").over(order), F.max("bucket").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    heads = F.broadcast(heads.select("head", before.alias("before")))
    halo = rows.join(heads, F.col("key") == F.col("head")).select(F.col("before").alias("bucket"), F.lit(1).alias("halo"), "key", "doc_id", "text")
    both = rows.select("bucket", F.lit(0).alias("halo"), "key", "doc_id", "text").unionByName(halo)
    return both.repartition("bucket").sortWithinPartitions("bucket", "halo", "key").select("bucket", "halo", "doc_id", "text")


def _edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def edit_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text (its last half replaced by the next document's first characters)."""
    rows = in_id_order(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # the last row so far with its sketch: its successor may come in the next batch
        for batch in batches:
            new = list(zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True))
            texts = [r[3] or "" for r in new]
            both = held + list(zip(new, texts, sketches(texts), strict=True))
            pairs = [(x, y) for x, y in zip(both, both[1:], strict=False) if not x[0][1] and x[0][0] == y[0][0]]
            held = both[-1:]
            edited = [_edited(x[1], y[1]) for x, y in pairs]
            marks = sketches(edited)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x[0][2] for x, _ in pairs], batch.schema.field(2).type),
                    pa.array([len(x[1]) for x, _ in pairs], pa.int64()),
                    pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited], pa.string()),
                    pa.array([as_text(x[2]) for x, _ in pairs], pa.string()),
                    pa.array([as_text(m) for m in marks], pa.string()),
                    pa.array([likeness(x[2], m) for (x, _), m in zip(pairs, marks, strict=True)], pa.float64()),
                    pa.array([likeness(x[2], y[2]) for x, y in pairs], pa.float64()),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return rows.mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
