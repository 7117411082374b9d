"""Near-duplicate detection by a chosen-path set similarity join.

A document's set is its distinct 2-word shingles.  Documents with equal sets
form one class, represented by its smallest id, so any number of copies is
one row of the join.  A class has a sketch: one byte of each of 64 minwise
hashes.

Independent trees branch the classes recursively: a node's path names one
chosen coordinate - with probability 1/4 a second one - and members with
the same minwise value there meet in the same child.  A pair of similarity
0.8 then keeps about one common child per level, unrelated pairs none.
Nodes of at most ``LEAF`` classes are compared exhaustively by sketch;
larger ones first with their smallest members.  Of a large node only pairs
of different components matter from then on.  If comparing all pairs of the
classes in such nodes takes no more work than another level, that is done,
block against block.  Else, where all but ``LEAF`` members are of one
component, the others are compared with every member, and the remaining nodes
are branched further.  The number of trees at a level follows from the target
recall for a pair right at the threshold, averaged over its number of equal
sketch bytes (all trees draw from the same bytes); each further level adds the
trees that it needs, over the classes in those nodes.

Sketches only propose pairs (38 of 64 matches are asked for; a pair at the
threshold has fewer with probability 1e-5).  Every link is confirmed on the
full sets, computed again from the texts of just the classes in question:
first a spanning forest of each node's pairs, then only those other pairs
whose ends are still apart, so a large group of near copies costs a few
confirmations per member, not per pair, and no link between components is
lost.  Members of large nodes meet as texts: a task holds some sets, tries the
others' closest candidates first and puts out only links that join components,
so no table holds the pairs of a family.

Every shuffle deals rows by a hash of path or id; a representative with many
partners is confirmed in several salted groups.

Defined cases: documents without words, and null text, have an empty set
and are linked to nothing; rows without an id are linked to nothing, have
component null and are kept; rows that share an id are one document (its
components are merged), of which the filter keeps one row.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import columns_of, mix64, pinned, slices
from shelfwise.llm.components import connected, dealt_to_few_files, in_few_files
from shelfwise.plans.materialize import materialize, remove_written

COORDINATES = 64
MIN_MATCHES = 38
LEAF = 64
LEADERS = 3
TARGET_RECALL = 0.9999
EXTRA = 0.25  # probability of a second coordinate at a node: 1 + EXTRA = 1 / 0.8
BACKGROUND = 0.05  # share of unrelated classes taken to meet at a coordinate
BLOCK_SHINGLES = 1_000_000  # of a block of texts that a task holds
LEAST_BLOCKS = 8
ROW_COST = 256  # comparisons that handling a node row one level down is taken for
HOT_PARTNERS = 500
SLICE_BYTES = 400_000
TEXTS_PER_FILE = 5_000

_G = np.random.Generator(np.random.PCG64(20))
BYTE_NAMES = _G.integers(0, 2**64, 256, np.uint64)
BYTE_NAMES[65:91] = BYTE_NAMES[97:123]  # A-Z like a-z
SPACES = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
PLACES = mix64(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)
XORS = _G.integers(0, 2**32, COORDINATES, np.uint32)
FACTORS = _G.integers(0, 2**32, COORDINATES, np.uint32) | np.uint32(1)


# ---- sets and sketches ----------------------------------------------------
def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, end of each text among the words)."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    space = SPACES[raw]
    begins = ~space
    begins[1:] &= space[:-1]
    at = np.flatnonzero(begins)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    inner = np.flatnonzero(~space)
    first = np.flatnonzero(begins[inner])
    length = np.diff(np.append(first, len(inner)))
    place = np.arange(len(inner)) - np.repeat(first, length)
    weight = PLACES[place] if length.max() <= len(PLACES) else mix64(place.astype(np.uint64) + np.uint64(1)) | np.uint64(1)
    h = np.add.reduceat(BYTE_NAMES[raw[inner]] * weight, first)
    return mix64(h + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), np.searchsorted(at, ends)


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted distinct 2-word shingles of each text, as 64-bit hashes."""
    out: list[np.ndarray] = []
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    for a, b in slices(map(len, data), SLICE_BYTES):
        words, ends = word_hashes(data[a:b])
        start = 0
        pairs = mix64(words[:-1] * np.uint64(0xA0761D6478BD642F) + (words[1:] ^ (words[1:] >> np.uint64(29)))) if len(words) else words
        for end in ends.tolist():
            if end - start > 1:
                out.append(np.unique(pairs[start : end - 1]))
            else:
                out.append(mix64(words[start:end] ^ np.uint64(0x5851F42D4C957F2D)))
            start = end
    return out


def sketch(members: np.ndarray) -> np.ndarray:
    """One byte of each coordinate's minwise hash."""
    low = np.full(COORDINATES, 2**32 - 1, np.uint32)
    for i in range(0, len(members), 4096):
        x = (members[i : i + 4096] >> np.uint64(32)).astype(np.uint32)[:, None] ^ XORS
        x *= FACTORS
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x ^= x >> np.uint32(13)
        np.minimum(low, x.min(axis=0), out=low)
    low = (low ^ (low >> np.uint32(16))) * np.uint32(0x45D9F3B)
    return (low >> np.uint32(24)).astype(np.uint8)


def matches(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal bytes by row of two byte matrices."""
    words = (a == b).view(np.uint64)
    return ((words.sum(axis=1, dtype=np.uint64) * np.uint64(0x0101010101010101)) >> np.uint64(56)).astype(np.int64)


def document_sets(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, key (digest of the set, null if empty), sketch."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = shingle_sets(b.column(1).to_pylist())
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            marks = [sketch(s).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(marks, pa.binary())],
                ["doc_id", "n_shingles", "key", "sketch"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, key binary, sketch binary")


# ---- trees ----------------------------------------------------------------
def survival(level: int, similarity: float = 0.8) -> float:
    """Probability that a pair still shares a node of one tree at a level."""
    gone = 0.0
    for _ in range(level):
        x = 1 - similarity + similarity * gone
        gone = (1 - EXTRA) * x + EXTRA * x * x
    return 1 - gone


def trees_at(level: int, recall: float = TARGET_RECALL) -> int:
    """Number of trees for the recall of a pair at the threshold, if nodes are small at this level.

    All trees share one sketch: the pair's number of equal bytes is binomial,
    and the trees are independent only for a given number.
    """
    equal = 0.8 + 0.2 / 256
    counts = range(MIN_MATCHES, COORDINATES + 1)
    share = [math.comb(COORDINATES, k) * equal**k * (1 - equal) ** (COORDINATES - k) for k in counts]
    gone = [1 - survival(level, k / COORDINATES) for k in counts]
    unseen = 1 - sum(share)  # too few equal bytes to be proposed at all

    def missed(trees: int) -> float:
        return unseen + sum(p * g**trees for p, g in zip(share, gone, strict=True))

    if unseen >= 1 - recall:
        raise ValueError(f"a sketch of {COORDINATES} bytes cannot reach a recall of {recall}")
    high = 1
    while missed(high) > 1 - recall:
        high *= 2
    low = high // 2
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if missed(middle) > 1 - recall else (low, middle)
    return high


def plan_trees(classes: int, recall: float = TARGET_RECALL) -> tuple[int, int]:
    """(first level at which nodes are expected to be small, number of trees for the recall there)."""
    level = max(1, math.ceil(math.log(max(classes, 1) / LEAF) / -math.log(BACKGROUND))) if classes > LEAF else 1
    return level, trees_at(level, recall)


def branch(node: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, child) for each row's children: the node alone decides the coordinates, the sketch the child."""
    rows = np.arange(len(node))
    draw = mix64(node ^ np.uint64(0xD1B54A32D192ED03))
    first = (draw & np.uint64(63)).astype(np.int64)
    more = np.flatnonzero(((draw >> np.uint64(12)) & np.uint64(0xFFFF)).astype(np.float64) < EXTRA * 65536)
    # the second coordinate differs from the first
    second = (first[more] + 1 + ((draw[more] >> np.uint64(6)) & np.uint64(63)).astype(np.int64) % (COORDINATES - 1)) % COORDINATES
    row, at = np.concatenate([rows, more]), np.concatenate([first, second])
    value = at.astype(np.uint64) * np.uint64(256) + marks[row, at] + np.uint64(1)
    return row, mix64(node[row] + value * np.uint64(0x9E3779B97F4A7C15))


def _sketch_matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, COORDINATES)


def _binary(marks: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(marks).tobytes()
    offsets = np.arange(len(marks) + 1, dtype=np.int32) * COORDINATES
    return pa.Array.from_buffers(pa.binary(), len(marks), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])


NODE_ROWS = "node long, cid long, comp long, size long, sketch binary"
NAMES = ["node", "cid", "comp", "size", "sketch"]


def _node_batch(node: np.ndarray, cid: np.ndarray, comp: np.ndarray, size: np.ndarray, marks: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(cid), pa.array(comp), pa.array(size), _binary(marks)], NAMES)


def _read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ints = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
    return ints[0].view(np.uint64), ints[1], ints[2], ints[3], _sketch_matrix(batch.column(4))


def root_nodes(classes: DataFrame, level: int, trees: int, first: int = 0) -> DataFrame:
    """Node rows of every class in every tree from ``first`` to ``trees``, at a level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cid, size = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            comp, marks = b.column(2).to_numpy(zero_copy_only=False), _sketch_matrix(b.column(3))
            for tree in range(first, trees):
                node, row = mix64(np.full(len(cid), tree + 1, np.uint64)), np.arange(len(cid))
                for _ in range(level):
                    up, node = branch(node, marks[row])
                    row = row[up]
                yield _node_batch(node, cid[row], comp[row], size[row], marks[row])

    return classes.select("cid", "size", "comp", "sketch").mapInArrow(run, NODE_ROWS)


def child_nodes(rows: DataFrame) -> DataFrame:
    """The next level's node rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, cid, comp, size, marks = _read(b)
            up, child = branch(node, marks)
            yield _node_batch(child, cid[up], comp[up], size[up], marks[up])

    return rows.select(*NAMES).mapInArrow(run, NODE_ROWS)


def _plausible(i: np.ndarray, j: np.ndarray, comp: np.ndarray, size: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Those pairs of rows that are apart so far and may reach the threshold, with their matches."""
    ok = (comp[i] != comp[j]) & (5 * np.minimum(size[i], size[j]) >= 4 * np.maximum(size[i], size[j]))
    i, j = i[ok], j[ok]
    m = matches(marks[i], marks[j])
    ok = m >= MIN_MATCHES
    return i[ok], j[ok], m[ok]


class NodeScan:
    """Walks node rows in (node, cid) order: pairs of small nodes, leader pairs and rows of large ones.

    A node that runs over a batch's end is held back while it is small, and
    known by its leaders once it is large, so a batch's worth of rows is all
    that is ever in memory.
    """

    def __init__(self) -> None:
        self.held: tuple | None = None
        self.large: tuple | None = None  # (node, its leaders' rows)

    def feed(self, rows: tuple, final: bool) -> Iterator[tuple[str, tuple]]:
        if self.held is not None:
            rows = tuple(np.concatenate([x, y]) for x, y in zip(self.held, rows, strict=True))
            self.held = None
        node = rows[0]
        if not len(node):
            return
        starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        lengths = np.diff(np.append(starts, len(node)))
        large = lengths > LEAF
        known = self.large is not None and self.large[0] == node[0]
        large[0] |= known
        if not final and not large[-1]:
            self.held = tuple(x[starts[-1] :] for x in rows)
            rows = tuple(x[: starts[-1]] for x in rows)
            starts, lengths, large = starts[:-1], lengths[:-1], large[:-1]
        small = np.repeat(~large, lengths)
        if small.any():
            yield "pairs", self._exhaustive(tuple(x[small] for x in rows))
        for s, n in zip(starts[large].tolist(), lengths[large].tolist(), strict=True):
            mine = tuple(x[s : s + n] for x in rows)
            if not (known and s == 0):
                self.large = (mine[0][0], tuple(x[:LEADERS] for x in mine))
            yield "pairs", self._with_leaders(mine)
            yield "rows", mine

    @staticmethod
    def _exhaustive(rows: tuple) -> tuple:
        node, cid, comp, size, marks = rows
        found = []
        for d in range(1, len(node)):
            i = np.flatnonzero(node[d:] == node[:-d])
            if not len(i):
                break
            x, y, m = _plausible(i, i + d, comp, size, marks)
            if len(x):
                found.append((x, y, m))
        if not found:
            none = np.zeros(0, np.int64)
            return none, none, none.astype(bool)
        i, j, m = (np.concatenate(x) for x in zip(*found, strict=True))
        # a spanning forest of each node: every row's best match among the rows before it
        order = np.lexsort((i, -m, j))
        i, j = i[order], j[order]
        tree = np.concatenate([[True], j[1:] != j[:-1]])
        return cid[i], cid[j], tree

    def _with_leaders(self, rows: tuple) -> tuple:
        lead = self.large[1]
        _, cid, comp, size, marks = (np.concatenate([x, y]) for x, y in zip(lead, rows, strict=True))
        n, k = len(rows[0]), len(lead[0])
        i, j = np.repeat(np.arange(k), n), np.tile(np.arange(k, k + n), k)
        apart = cid[i] != cid[j]
        i, j, _ = _plausible(i[apart], j[apart], comp, size, marks)
        return cid[i], cid[j], np.ones(len(i), bool)


PAIRS = "a long, b long, tree boolean"
SCANNED = f"{PAIRS}, {NODE_ROWS}"


def _pair_columns(a: np.ndarray, b: np.ndarray, tree: np.ndarray) -> list[pa.Array]:
    return [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(tree)]


def scan_nodes(rows: DataFrame) -> DataFrame:
    """Proposed pairs (a, b, tree) of all nodes and, where ``a`` is null, the rows of large nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = NodeScan()
        empty = tuple(np.zeros((0, COORDINATES) if i == 4 else 0, np.uint8 if i == 4 else np.uint64 if i == 0 else np.int64) for i in range(5))

        def out(found: Iterator[tuple[str, tuple]]) -> Iterator[pa.RecordBatch]:
            for kind, x in found:
                n = len(x[0])
                if kind == "pairs" and n:
                    cols = [*_pair_columns(*x), *[pa.nulls(n, pa.int64())] * 4, pa.nulls(n, pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, ["a", "b", "tree", *NAMES])
                elif kind == "rows":
                    cols = [*[pa.nulls(n, pa.int64())] * 2, pa.nulls(n, pa.bool_()), *_node_batch(*x).columns]
                    yield pa.RecordBatch.from_arrays(cols, ["a", "b", "tree", *NAMES])

        for b in batches:
            if b.num_rows:
                yield from out(scan.feed(_read(b), False))
        yield from out(scan.feed(empty, True))

    dealt = rows.repartition("node").sortWithinPartitions("node", "cid")
    return dealt.mapInArrow(run, SCANNED)


MASKED = "node long, cid long, comp long, slot int, mask long"


def outsider_masks(rows: DataFrame) -> DataFrame:
    """For each node's rows marked ``outside``, at most LEAF, which other rows may be linked with them.

    One row (node, cid, comp, slot, mask) for each outsider, numbered by
    ``slot``, and one with slot null for each row that some outsiders' sketches
    come close to: bit s of ``mask`` stands for the outsider of slot s.  The
    outsiders come first and are held while the other rows pass by, so what is
    made grows with the rows, not with the pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for b in batches:
            data, outside = _read(b), b.column(5).to_numpy(zero_copy_only=False).astype(bool)
            slot, mask = np.full(b.num_rows, -1, np.int64), np.zeros(b.num_rows, np.uint64)
            starts = np.flatnonzero(np.concatenate([[True], data[0][1:] != data[0][:-1]])) if b.num_rows else []
            for s, e in zip(starts, [*starts[1:], b.num_rows], strict=True):
                mine, own = tuple(x[s:e] for x in data), outside[s:e]
                if held is None or held[0][0] != mine[0][0]:
                    held = tuple(x[:0].copy() for x in mine)
                before = len(held[0])
                held = tuple(np.concatenate([x, y[own]]) for x, y in zip(held, mine, strict=True))
                k, n = len(held[0]), e - s
                slot[s:e][own] = np.arange(before, k)
                _, _, comp, size, marks = (np.concatenate([x, y]) for x, y in zip(held, mine, strict=True))
                i, j = np.repeat(np.arange(k), n), np.tile(np.arange(k, k + n), k)
                i, j, _ = _plausible(i, j, comp, size, marks)
                np.bitwise_or.at(mask, s + j - k, np.uint64(1) << i.astype(np.uint64))
            keep = (slot >= 0) | (mask != 0)
            cols = [pa.array(data[0].view(np.int64)[keep]), pa.array(data[1][keep]), pa.array(data[2][keep])]
            cols += [pa.array(slot[keep].astype(np.int32), mask=slot[keep] < 0), pa.array(mask[keep].view(np.int64))]
            yield pa.RecordBatch.from_arrays(cols, ["node", "cid", "comp", "slot", "mask"])

    dealt = rows.repartition("node").sortWithinPartitions("node", F.desc("outside"), "cid")
    return dealt.select(*NAMES, "outside").mapInArrow(run, MASKED)


class Held:
    """Texts' sets that a task holds, to confirm other texts against; links that join nothing new are left out.

    Components merge here as links are found: of the candidates in one
    component the closest is tried first, and one link is enough.
    """

    def __init__(self) -> None:
        self.cid: list[int] = []
        self.sets: list[np.ndarray] = []
        self.comp: list[int] = []
        self.up: dict[int, int] = {}

    def add(self, cid: int, comp: int, members: np.ndarray) -> None:
        self.cid.append(cid)
        self.comp.append(comp)
        self.sets.append(members)

    def root(self, c: int) -> int:
        while c in self.up:
            c = self.up[c]
        return c

    def reaching(self, members: np.ndarray, candidates: list[int]) -> list[int]:
        """Those candidates whose similarity with ``members`` is 0.8 or more."""
        sets = [self.sets[i] for i in candidates]
        lengths = np.fromiter(map(len, sets), np.int64, len(sets))
        every = np.concatenate(sets)
        at = np.searchsorted(members, every)
        at[at == len(members)] = 0
        both = np.add.reduceat((members[at] == every).astype(np.int64), np.concatenate([[0], np.cumsum(lengths)[:-1]]))
        return [i for i, ok in zip(candidates, (100 * both >= 80 * (len(members) + lengths - both)).tolist(), strict=True) if ok]

    def links(self, comp: int, members: np.ndarray, candidates: list[int]) -> list[int]:
        """Indices of held texts, one for each other component that is linked; candidates come closest first."""
        found: list[int] = []
        width = 1  # tried of each component at once; doubled while none of them is linked
        while candidates:
            now, rest, mine, tried = [], [], self.root(comp), Counter()
            for i in candidates:
                r = self.root(self.comp[i])
                if r != mine:
                    tried[r] += 1
                    (now if tried[r] <= width else rest).append(i)
            if not now:
                break
            for i in self.reaching(members, now):
                r, mine = self.root(self.comp[i]), self.root(comp)
                if r != mine:
                    self.up[max(r, mine)] = min(r, mine)
                    found.append(i)
            candidates, width = rest, 2 * width
        return found


def _link_batch(a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def confirm_masks(masked: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) of the rows of :func:`outsider_masks`, confirmed on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, of_slot = None, Held(), defaultdict(list)
        for batch in batches:
            found: tuple[list[int], list[int]] = ([], [])
            columns = (batch.column(i).to_pylist() for i in range(5))
            for node, cid, comp, slot, mask, members in zip(*columns, shingle_sets(batch.column(5).to_pylist()), strict=True):
                if node != at:
                    at, held, of_slot = node, Held(), defaultdict(list)
                # an outsider's mask may name outsiders after it: those meet it from their side
                for i in held.links(comp, members, [i for s in range(LEAF) if mask >> s & 1 for i in of_slot[s]]):
                    found[0].append(held.cid[i])
                    found[1].append(cid)
                if slot is not None:
                    of_slot[slot].append(len(held.cid))
                    held.add(cid, comp, members)
            yield _link_batch(*found)

    dealt = masked.join(texts, "cid").repartition("node").sortWithinPartitions("node", F.asc_nulls_last("slot"), "cid")
    return dealt.select("node", "cid", "comp", "slot", "mask", "text").mapInArrow(run, "a long, b long")


def link_all(classes: DataFrame, texts: DataFrame, shingles: int) -> DataFrame:
    """Links (a, b) among all pairs of the classes, confirmed on full sets: every two blocks of them meet in one task.

    ``shingles`` is the classes' total size; it sets the number of blocks, so
    a block's sets take a bounded amount of memory.  Only links between
    different components come out, one for each pair of them and task.
    """
    blocks = max(LEAST_BLOCKS, math.ceil(shingles / BLOCK_SHINGLES))
    dealt = classes.withColumn("block", F.pmod(F.xxhash64("cid"), F.lit(blocks))).join(texts, "cid")
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    dealt = dealt.withColumn("node", F.least("block", "other") * blocks + F.greatest("block", "other"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, Held()
        marks, size = np.zeros((256, COORDINATES), np.uint8), np.zeros(256, np.int64)
        for b in batches:
            found: tuple[list[int], list[int]] = ([], [])
            node, cid, comp = (b.column(i).to_pylist() for i in (0, 1, 2))
            own_size, own_marks = b.column(3).to_numpy(zero_copy_only=False), _sketch_matrix(b.column(4))
            block, sets = b.column(5).to_pylist(), shingle_sets(b.column(6).to_pylist())
            for r in range(b.num_rows):
                if node[r] != at:
                    at, held = node[r], Held()
                k, (low, high) = len(held.cid), divmod(node[r], blocks)
                # the lower block is held; the other block's rows meet it, or else each row those before it
                if block[r] == high:
                    m = matches(marks[:k], np.broadcast_to(own_marks[r], (k, COORDINATES)))
                    near = np.flatnonzero((m >= MIN_MATCHES) & (5 * np.minimum(size[:k], own_size[r]) >= 4 * np.maximum(size[:k], own_size[r])))
                    for i in held.links(comp[r], sets[r], near[np.argsort(-m[near], kind="stable")].tolist()):
                        found[0].append(held.cid[i])
                        found[1].append(cid[r])
                if block[r] == low:
                    if k == len(marks):
                        marks, size = np.concatenate([marks, np.zeros_like(marks)]), np.concatenate([size, np.zeros_like(size)])
                    marks[k], size[k] = own_marks[r], own_size[r]
                    held.add(cid[r], comp[r], sets[r])
            yield _link_batch(*found)

    dealt = dealt.repartition("node").sortWithinPartitions("node", "block", "cid")
    return dealt.select("node", "cid", "comp", "size", "sketch", "block", "text").mapInArrow(run, "a long, b long")


# ---- confirmation ----------------------------------------------------------
def texts_of(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """cid, text of the ids in a written table (cid)."""
    texts = docs.select(F.col("doc_id").alias("cid"), "text").join(wanted, "cid")
    return dealt_to_few_files(texts, wanted.count(), TEXTS_PER_FILE)


def confirmed(pairs: DataFrame, docs: DataFrame, written: list[str]) -> DataFrame:
    """Those pairs (a, b) whose full sets reach 0.8, as a written table."""
    spark = docs.sparkSession
    own: list[str] = []
    n = pairs.count()
    pairs = materialize(in_few_files(pairs.distinct(), n), "pairs", own)
    wanted = pairs.select(F.col("a").alias("cid")).unionAll(pairs.select(F.col("b").alias("cid"))).distinct()
    wanted = materialize(in_few_files(wanted, 2 * n), "wanted", own)
    texts = materialize(texts_of(wanted, docs), "wanted_texts", own)
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / HOT_PARTNERS).alias("salts"))
    left = texts.join(salts, F.col("cid") == F.col("a")).select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), "text")
    right = pairs.join(salts, "a").join(texts, F.col("b") == F.col("cid"))
    right = right.select("a", F.pmod(F.xxhash64("b"), F.col("salts")).alias("salt"), "b", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sets = None, []
        for batch in batches:
            a, salt, b = (batch.column(i).to_pylist() for i in range(3))
            found_a, found_b = [], []
            for x, s, y, members in zip(a, salt, b, shingle_sets(batch.column(3).to_pylist()), strict=True):
                if (x, s) != at:
                    at, sets = (x, s), []
                if y is None:
                    sets.append(members)
                    continue
                for other in sets:
                    both = len(np.intersect1d(other, members, assume_unique=True))
                    if 100 * both >= 80 * (len(other) + len(members) - both) and both:
                        found_a.append(x)
                        found_b.append(y)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], ["a", "b"])

    together = left.unionByName(right).repartition("a", "salt").sortWithinPartitions("a", "salt", F.asc_nulls_first("b"))
    links = materialize(dealt_to_few_files(together.mapInArrow(run, "a long, b long"), n), "links", written)
    remove_written(spark, own)
    return links


def _apart(rows: DataFrame, components: DataFrame, *ids: str) -> DataFrame:
    """``rows`` with the component of each id column, as ``<id>_c``."""
    for c in ids:
        known = components.select(F.col("node").alias(f"{c}_n"), F.col("component").alias(f"{c}_k"))
        rows = rows.join(known, F.col(c) == F.col(f"{c}_n"), "left").withColumn(f"{c}_c", F.coalesce(f"{c}_k", c)).drop(f"{c}_n", f"{c}_k")
    return rows


class Join:
    """The state of one join: the classes, links found so far and their components."""

    def __init__(self, docs: DataFrame, recall: float = TARGET_RECALL) -> None:
        self.docs = columns_of(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        self.spark = docs.sparkSession
        self.recall = recall
        self.scratch: list[str] = []
        self.latest: list[str] = []  # the table of ``components``
        kept: list[str] = []
        rows = self.docs.count()
        self.sets = materialize(dealt_to_few_files(document_sets(self.docs), rows), "shingle_sets", kept)
        usable = self.sets.where("key IS NOT NULL AND doc_id IS NOT NULL")
        by_key = usable.groupBy("key").agg(F.min("doc_id").alias("cid"), F.first("n_shingles").alias("size"), F.first("sketch").alias("sketch"))
        self.classes = materialize(in_few_files(by_key, rows), "set_classes", kept)
        self.links: list[DataFrame] = []
        self.components = self.spark.createDataFrame([], "node long, component long")

    def _members(self) -> DataFrame:
        """doc_id, n_shingles, cid of every row; cid is null where nothing can be linked."""
        names = self.classes.select("key", "cid")
        return self.sets.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("key")).alias("key")).join(names, "key", "left").drop("key")

    def _connect(self, new: DataFrame) -> None:
        old = self.components.select(F.col("node").alias("a"), F.col("component").alias("b"))
        own: list[str] = []
        self.components = connected(old.unionByName(new.select("a", "b")), own)
        self.scratch += self.latest
        self.latest = own

    def run(self) -> None:
        """Find all links; afterwards only the tables that :meth:`report` reads are left."""
        self._branch()
        remove_written(self.spark, self.scratch)

    def _branch(self) -> None:
        self._connect_shared_ids()
        count = self.classes.count()
        level, trees = plan_trees(count, self.recall)
        scanned = scan_nodes(root_nodes(self.classes.withColumn("comp", F.col("cid")), level, trees))
        while True:
            own: list[str] = []
            found = materialize(scanned, "node_scan", own)
            self._link_all(found.where("a IS NOT NULL"))
            large = found.where("a IS NULL").select(*NAMES)
            n = large.count()
            if not n:
                remove_written(self.spark, own)
                return
            open_rows = materialize(self._open_rows(large), "open_nodes", own)
            if self._finished(open_rows, level, trees, own):
                remove_written(self.spark, own)
                return
            few = outsider_masks(open_rows.where(f"n_outside <= {LEAF}"))
            self._add_links(confirm_masks(materialize(few, "outsiders", own), self._texts(open_rows, n, own)), n, own)
            still = open_rows.where(f"n_outside > {LEAF}")
            classes = materialize(in_few_files(self._still_open(still), n), "open_classes", own)
            if classes.isEmpty():
                remove_written(self.spark, own)
                return
            level += 1
            needed = max(trees, trees_at(level, self.recall))
            rows = child_nodes(still)
            if needed > trees:
                rows = rows.unionByName(root_nodes(classes, level, needed, trees))
                trees = needed
            rows = materialize(rows, "child_nodes", self.scratch)
            remove_written(self.spark, own)
            scanned = scan_nodes(rows)

    def _finished(self, open_rows: DataFrame, level: int, trees: int, own: list[str]) -> bool:
        """Whether nothing is open, or little enough that all its pairs take no more work than the next level: then they are compared here."""
        classes = materialize(self._still_open(open_rows), "open_classes", own)
        n, shingles = classes.agg(F.count("*"), F.sum("size")).first()
        if not n:
            return True
        if n > 2 * ROW_COST * max(trees, trees_at(level + 1, self.recall)) * (1 + EXTRA) ** (level + 1):
            return False
        self._add_links(link_all(classes, self._texts(classes, n, own), shingles), n, own)
        return True

    def _texts(self, rows: DataFrame, most: int, own: list[str]) -> DataFrame:
        """cid, text of the rows' classes (``most`` rows), as a written table."""
        wanted = materialize(in_few_files(rows.select("cid").distinct(), most), "open_ids", own)
        return materialize(texts_of(wanted, self.docs), "open_texts", own)

    def _add_links(self, links: DataFrame, rows: int, own: list[str]) -> None:
        links = materialize(dealt_to_few_files(links, rows), "open_links", own)
        if not links.isEmpty():
            self._connect(links)

    def _open_rows(self, large: DataFrame) -> DataFrame:
        """Rows of the nodes that hold several components, with ``outside`` (not of the node's main one) and ``n_outside``."""
        now = _apart(large, self.components, "cid").drop("comp").withColumnRenamed("cid_c", "comp")
        parts = now.groupBy("node", "comp").agg(F.count("*").alias("n"))
        nodes = parts.groupBy("node").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), (F.sum("n") - F.max("n")).alias("n_outside"))
        return now.join(nodes.where("n_outside > 0"), "node").withColumn("outside", F.col("comp") != F.col("main"))

    def _still_open(self, rows: DataFrame) -> DataFrame:
        """One row for each class of these node rows, with its component."""
        one = rows.groupBy("cid").agg(F.first("size").alias("size"), F.first("sketch").alias("sketch"))
        return _apart(one, self.components, "cid").withColumnRenamed("cid_c", "comp")

    def _link_all(self, pairs: DataFrame) -> None:
        """Confirm a spanning forest of the proposed pairs, then those other pairs whose ends are still apart."""
        self._link(pairs.where("tree").select("a", "b"))
        rest = _apart(pairs.where("NOT tree").select("a", "b"), self.components, "a", "b")
        self._link(rest.where("a_c <> b_c").select("a", "b"))

    def _link(self, pairs: DataFrame) -> None:
        if pairs.isEmpty():
            return
        links = confirmed(pairs, self.docs, self.scratch)
        if not links.isEmpty():
            self._connect(links)

    def _connect_shared_ids(self) -> None:
        """Rows that share an id are one document, whatever their sets."""
        members = self._members().where("cid IS NOT NULL")
        first = members.groupBy("doc_id").agg(F.min("cid").alias("a"), F.max("cid").alias("last")).where("a <> last").select("doc_id", "a")
        first = materialize(first, "shared_ids", self.scratch)
        if not first.isEmpty():
            self._connect(members.join(first, "doc_id").select("a", F.col("cid").alias("b")).distinct())

    def report(self) -> DataFrame:
        rows = _apart(self._members(), self.components, "cid")
        component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.least("doc_id", F.col("cid_c")))
        return rows.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_duplicates(docs: DataFrame, recall: float = TARGET_RECALL) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest id reachable over links), kept."""
    join = Join(docs, recall)
    join.run()
    return join.report()


def drop_near_duplicates(docs: DataFrame, recall: float = TARGET_RECALL) -> DataFrame:
    """The documents of smallest id of each component, one row each, with their own columns."""
    gone = near_duplicates(docs, recall).where("NOT kept").select(F.col("doc_id").alias("gone_id")).distinct()
    inner, (doc_id,) = pinned(docs, "doc_id")
    left = inner.join(gone, F.col(doc_id) == F.col("gone_id"), "left_anti")
    repeated = columns_of(docs, doc_id="doc_id").where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").limit(1).count()
    if repeated:
        nulls = left.where(F.col(doc_id).isNull())
        left = left.where(F.col(doc_id).isNotNull()).dropDuplicates([doc_id]).unionByName(nulls)
    return left.select(*inner.columns).toDF(*docs.columns)
