"""Lineage cuts: write a stage once to the cluster's shared checkpoint folder.

A stage that several downstream steps read (the raw table built from
joins, the pair rollup, a frozen range-bucket assignment) is written as
Parquet under ``spark.checkpoint.dir`` and read back.  Unlike a cache,
the written table survives executor loss, and unlike an RDD checkpoint
it is computed once (no second pass to write the checkpoint) and stays
columnar, so later readers still get column pruning, filter pushdown
and real size statistics.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_CONF_KEY = "spark.checkpoint.dir"


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for lineage cuts.

    Uses the folder the cluster configured (``spark.checkpoint.dir`` or
    ``SparkContext.setCheckpointDir``).  Only a local-mode session with
    nothing configured (tests, a laptop) gets a fresh temporary folder;
    on a cluster a machine-local folder would be wrong, so it is an error.
    """
    sc = spark.sparkContext
    root = sc.getCheckpointDir()
    if root:
        return root
    root = spark.conf.get(_CONF_KEY, None) or sc.getConf().get(_CONF_KEY, None)
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                f"{_CONF_KEY} is not set: point it at a folder every executor can reach"
            )
        root = tempfile.mkdtemp(prefix="shelfwise-ckpt-")
    sc.setCheckpointDir(root)
    return sc.getCheckpointDir() or root


def materialize(df: DataFrame, name: str, registry: list[str] | None = None) -> DataFrame:
    """Write ``df`` once under the checkpoint folder and return a scan of it.

    The written path is appended to ``registry`` so its owner can remove
    it with :func:`remove_written` when no reader needs it any more.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/shelfwise/{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    if registry is not None:
        registry.append(path)
    return spark.read.parquet(path)


def remove_written(spark: SparkSession, paths: list[str]) -> None:
    """Delete stage tables this library wrote (on whatever file system holds them).

    Works after the session was stopped too, as long as its JVM runs; a JVM
    that is already gone leaves nothing to call.
    """
    jvm = SparkContext._jvm
    gateway = SparkContext._gateway
    if jvm is None or gateway is None or (getattr(gateway, "proc", None) is not None and gateway.proc.poll() is not None):
        paths.clear()
        return
    stopped = spark.sparkContext._jsc is None
    conf = jvm.org.apache.hadoop.conf.Configuration() if stopped else spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        jpath = jvm.org.apache.hadoop.fs.Path(p)
        jpath.getFileSystem(conf).delete(jpath, True)
    paths.clear()
