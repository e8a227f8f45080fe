"""Session helpers: building a local session for tests/bench, and reading the
cluster's shared checkpoint folder.

The library never invents a storage location on a cluster: ``checkpoint_dir``
only reports what the session was configured with.  Tests and the bench name a
scratch folder themselves when the setting is missing.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "residuum") -> SparkSession:
    """A session tuned for this library: AQE on, UTC, Arrow, UI off.

    ``master`` defaults to ``local[$BENCH_CPUS]`` (or ``local[*]``).  On a real
    cluster the master and sizing come from ``spark-submit`` instead and this
    helper is not used.
    """
    cpus = os.environ.get("BENCH_CPUS")
    master = master or (f"local[{cpus}]" if cpus else "local[*]")
    parts = shuffle_partitions or int(cpus or os.cpu_count() or 8)
    spark = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.default.parallelism", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize",
                os.environ.get("RESIDUUM_MIN_PARTITION", "256k"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared checkpoint folder named by the cluster, or ``None``."""
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if configured:
        spark.sparkContext.setCheckpointDir(configured)
        return spark.sparkContext.getCheckpointDir()
    return None
