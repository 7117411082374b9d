"""Session defaults for running the analysis."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(master: str | None = None, app: str = "shelfwise", **conf: str) -> SparkSession:
    """Build (or reuse) a session with the analysis defaults.

    On a cluster leave ``master`` unset and size
    ``spark.sql.shuffle.partitions`` to the data; ``spark.checkpoint.dir``
    must name a folder every executor can reach.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in {**DEFAULT_CONF, **conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def local_session(cores: int = 8, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A local-mode session sized for tests and single-machine runs."""
    return get_session(
        f"local[{cores}]",
        **{
            "spark.sql.shuffle.partitions": str(shuffle_partitions or cores),
            "spark.driver.memory": "8g",
            **conf,
        },
    )
