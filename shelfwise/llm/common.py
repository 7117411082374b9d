"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
# rows and bytes per Arrow batch handed to Python: they bound a worker's memory when texts are long
ARROW_ROWS = 1000
ARROW_BYTES = 8_000_000


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to what the operators' workers are meant for, never raise them."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        now = spark.conf.get(key)
        if not (now and now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pinned(df: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """``df`` with its columns renamed by position, and the new name of each of ``names``.

    Operators work on the renamed frame, so extra columns can never clash
    with the names an operator uses itself, not even in another letter case.
    An exact match wins over one in another case; a missing column is an error.
    """
    bounded_batches(df.sparkSession)
    inner = df.toDF(*[f"in_{i}" for i in range(len(df.columns))])
    found = []
    for name in names:
        exact = [i for i, c in enumerate(df.columns) if c == name]
        loose = [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
        if not (exact or loose):
            raise ValueError(f"no column {name!r} in {df.columns}")
        found.append(f"in_{(exact or loose)[0]}")
    return inner, found


def columns_of(df: DataFrame, **wanted: str) -> DataFrame:
    """Just the wanted columns, as ``new_name=column``."""
    inner, found = pinned(df, *wanted.values())
    return inner.select(*[F.col(c).alias(n) for n, c in zip(wanted, found, strict=True)])


def filtered(df: DataFrame, keep: Column, inner: DataFrame) -> DataFrame:
    """Rows of a pinned frame that satisfy ``keep``, under the original column names."""
    return inner.where(keep).select(*inner.columns).toDF(*df.columns)


def row_key(doc_id: str = "doc_id", text: str | None = None) -> Column:
    """A document's name in seeded draws: its id as text; without one, its text's digest."""
    own = F.col(doc_id).cast("string")
    if text is None:
        return F.coalesce(own, F.lit("null"))
    return F.coalesce(own, F.concat(F.lit("t"), F.md5(F.coalesce(F.col(text), F.lit("")))))


def seeded_hex(seed: int, *parts: Column) -> Column:
    """Seeded md5 of the parts, in hex; the same in any SQL engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))


def shipped(spark: SparkSession, value: object) -> Broadcast[bytes]:
    """A broadcast of an object of this subpackage as plain bytes; :func:`unpacked` rebuilds it where the library is not installed."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def unpacked(shared: Broadcast[bytes]) -> object:
    return pickle.loads(shared.value)


def slices(lengths: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive items whose lengths add up to ``most`` or a bit more."""
    start = total = end = 0
    for end, n in enumerate(lengths, 1):
        total += n
        if total >= most:
            yield start, end
            start, total = end, 0
    if end > start:
        yield start, end


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' code points in one array, and where each text ends in it."""
    parts = [t.encode("utf-32-le", "surrogatepass") for t in texts]
    ends = np.cumsum(np.fromiter((len(p) // 4 for p in parts), np.int64, len(parts)))
    return np.frombuffer(b"".join(parts), np.uint32), ends


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (multiply and xor-shift), elementwise; returns a new array."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
