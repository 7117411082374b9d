"""Sinks: dashboard-ready mart exports, published all at once.

Every export writes a version folder of its own, several marts side by side;
row counts and checks ride on the writing jobs as observed metrics.  Only when
every mart is written and every check holds does the manifest - one small file
that readers follow - move to the new version.  A failed export removes its
folder and leaves the last one as it was.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

MANIFEST = "_manifest.json"
WRITERS = 4  # marts written at the same time


class ExportError(RuntimeError):
    """An export that was not published, with the reasons."""


@dataclass(frozen=True)
class Check:
    """What must hold of a mart: so many rows (None: any number), and no NULL in these columns."""

    rows: int | None = None
    labels: tuple[str, ...] = field(default_factory=tuple)


def write_mart(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> str:
    """Write one mart table; CSV gets a header row for spreadsheet users."""
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer = writer.option("header", "true")
    writer.format(fmt).save(path)
    return path


def _write_checked(df: DataFrame, name: str, path: str, fmt: str, check: Check) -> tuple[int, list[str]]:
    """(rows, what does not hold) of a mart, counted by the job that writes it."""
    seen = Observation(f"export of {name}")
    missing = F.coalesce(F.sum(sum((F.col(c).isNull().cast("long") for c in check.labels), F.lit(0).cast("long"))), F.lit(0))
    write_mart(df.observe(seen, F.count(F.lit(1)).alias("rows"), missing.alias("missing")), path, fmt)
    rows, missing_labels = seen.get["rows"], seen.get["missing"]
    wrong = [f"{name}: {missing_labels} labels are NULL"] if missing_labels else []
    if check.rows is not None and rows != check.rows:
        wrong.append(f"{name}: {rows} rows, but there are {check.rows} store-product pairs")
    return rows, wrong


def _path(spark: SparkSession, path: str):  # noqa: ANN202
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _delete(spark: SparkSession, path: str) -> None:
    p = _path(spark, path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _move_manifest(spark: SparkSession, out_dir: str, text: str) -> None:
    """Replace the manifest in one rename, on whatever file system the folder is."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    new, final = _path(spark, f"{out_dir}/{MANIFEST}.{uuid.uuid4().hex}"), _path(spark, f"{out_dir}/{MANIFEST}")
    stream = new.getFileSystem(conf).create(new)
    stream.write(bytearray(text.encode()))
    stream.close()
    fs = spark._jvm.org.apache.hadoop.fs
    options = spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
    options[0] = fs.Options.Rename.OVERWRITE
    full = final.getFileSystem(conf).makeQualified(final)
    fs.FileContext.getFileContext(full.toUri(), conf).rename(new.getFileSystem(conf).makeQualified(new), full, options)


def manifest(spark: SparkSession, out_dir: str) -> dict:
    """The published version: its name, the one before, the format and each mart's rows; empty if nothing is published."""
    p = _path(spark, f"{out_dir.rstrip('/')}/{MANIFEST}")
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return {}
    stream = fs.open(p)  # a hidden name, which Spark's own readers pass over
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def read_mart(spark: SparkSession, out_dir: str, name: str) -> DataFrame:
    """A mart of the published version."""
    now = manifest(spark, out_dir)
    if name not in now.get("rows", {}):
        raise KeyError(f"{name} is not published under {out_dir}")
    reader = spark.read.option("header", "true") if now["format"] == "csv" else spark.read
    return reader.format(now["format"]).load(f"{out_dir.rstrip('/')}/{now['version']}/{name}")


def publish_marts(
    marts: Mapping[str, DataFrame], out_dir: str, fmt: str = "parquet", checks: Mapping[str, Check] | None = None, writers: int = WRITERS
) -> dict[str, str]:
    """Write every mart and publish them together; returns name -> path.

    The version published before stays readable until the next export, for
    readers that have opened it.
    """
    if not marts:
        return {}
    spark = next(iter(marts.values())).sparkSession
    out_dir, version = out_dir.rstrip("/"), f"version-{uuid.uuid4().hex}"
    last = manifest(spark, out_dir)
    paths = {name: f"{out_dir}/{version}/{name}" for name in marts}

    def write(name: str) -> tuple[str, int, list[str]]:
        # a pool of its own, where the session schedules pools fairly
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"export-{name}")
        return name, *_write_checked(marts[name], name, paths[name], fmt, (checks or {}).get(name, Check()))

    try:
        with ThreadPoolExecutor(writers) as pool:
            done = [t.result() for t in [pool.submit(inheritable_thread_target(spark)(write), name) for name in marts]]
        wrong = [x for _, _, found in done for x in found]
        if wrong:
            raise ExportError("; ".join(wrong))
        _move_manifest(spark, out_dir, json.dumps({"version": version, "before": last.get("version"), "format": fmt, "rows": {name: rows for name, rows, _ in done}}))
    except BaseException:
        _delete(spark, f"{out_dir}/{version}")
        raise
    if last.get("before"):
        _delete(spark, f"{out_dir}/{last['before']}")
    return paths
