"""Default parameters and the Spark settings the jobs are designed for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Defaults a run uses when neither the call nor the domain sets them.
MIN_COUNT = 100
TOP_URLS = 100
TOP_AGENTS = 50
TOP_REFERERS = 100
TOP_METHODS = 10
TOP_PORTS = 2
DOMAIN_LIST_SIZE = 100
DOMAIN_LIST_MIN_COUNT = 1000
TOO_BIG_CONTENT = 1048576
REQUEST_TIMEOUT_MS = 15000
PASSED_RATIO = 95.0
INDEX_PREFIX = "logstash-"
NO_DOMAIN = "-"

# A side of a join is broadcast only when its measured text is at most this big.
BROADCAST_BYTES = 64 * 1024 * 1024
# Domain lists up to this length are turned into a literal filter for the scan.
INLINE_DOMAINS = 1000

# The largest top-K there is; ranking then always starts inside the tasks.
LARGEST_TOP = 10_000

SPARK_CONF = {
    # top-K up to this size is cut down before the shuffle
    "spark.sql.optimizer.windowGroupLimitThreshold": str(LARGEST_TOP),
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # HotSpot leaves longer methods uncompiled; Spark then generates shorter ones
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.ui.enabled": "false",
}

# Starting points for a cluster. The scans read few columns of wide rows, so big
# splits still make short tasks. Map tasks times shuffle partitions is the number of
# shuffle blocks: 100 TB in 4 GB splits are 25,000 tasks, times 8000 is 200 million
# blocks, of counts already combined. Adaptive execution merges the partitions for the
# small jobs.
CLUSTER_CONF = {
    "spark.sql.files.maxPartitionBytes": "4g",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "8000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
}


def session(app: str = "headerwise", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings above; ``conf`` keys use ``__`` for dots.

    The cluster settings apply unless ``master`` is a local one.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    local = (master or "").startswith("local")
    for key, value in (SPARK_CONF if local else SPARK_CONF | CLUSTER_CONF).items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
