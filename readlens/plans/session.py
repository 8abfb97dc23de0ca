"""Session settings the jobs are written for.

* Adaptive execution on: shuffle partitions are coalesced to the advisory size
  at runtime, a join side measured under ``autoBroadcastJoinThreshold`` is
  broadcast (a size check made on real statistics; bigger sides keep the
  sort-merge join), and skewed join partitions are split.
* ANSI mode stays on; the operators use ``try_cast`` / ``try_divide``.
* Session time zone UTC; text dates are parsed as text anyway.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.session.timeZone": "UTC",
}


# Adaptive execution joins small shuffle partitions but doesn't split those of an aggregate, so a cluster job starts
# from many.  Local sessions keep their own number.
CLUSTER_CONF = {"spark.sql.adaptive.coalescePartitions.initialPartitionNum": "8192"}


def configure(spark: SparkSession, shuffle_partitions: int | None = None) -> SparkSession:
    """Apply the runtime settings to an existing session (cluster sessions keep
    their own resource settings)."""
    on_cluster = not spark.conf.get("spark.master", "local").startswith("local")
    for k, v in (RUNTIME_CONF | (CLUSTER_CONF if on_cluster else {})).items():
        spark.conf.set(k, v)
    if shuffle_partitions:
        spark.conf.set("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "readlens") -> SparkSession:
    """A local session for tests and the bench (UI off, no server ports)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for k, v in RUNTIME_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
