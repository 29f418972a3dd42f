"""Session defaults used by the tests and the benchmark.

The library itself never changes a session it is handed; on a cluster the
caller's own configuration applies.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import SparkSession


def local_session(
    cpus: int | str = "*",
    shuffle_partitions: int = 8,
    name: str = "spanwise",
    conf: Mapping[str, str] | None = None,
) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        # Recording the Python line of every column expression slows down wide plans.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in (conf or {}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
