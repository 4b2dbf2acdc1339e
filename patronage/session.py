"""Session settings the library is written for.

The library never needs a special session: it only reads what is set. These
helpers give a sensible session for tests and the benchmark, and apply the
settings a cluster job should carry (AQE with skew-join and partition
coalescing). Results do not depend on the session's time zone.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings every job built on this library relies on. AQE re-plans joins from
# the measured size of each finished shuffle (a runtime broadcast only below
# its threshold, so the size is known, not estimated), splits skewed
# partitions and coalesces small ones. The static threshold stays at Spark's
# default: file-size estimates are only a guess at in-memory size.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.autoBroadcastJoinThreshold": str(10 * 1024 * 1024),
    # Spark pushes a longer IN list as its bounds only; the catalog alone has 19 contracts
    "spark.sql.parquet.pushdown.inFilterThreshold": "1000",
}


def cluster_conf(input_bytes: int, target_partition_bytes: int = 256 * 1024 * 1024) -> dict[str, str]:
    """Shuffle sizing for a job that reads about ``input_bytes``.

    Starts with enough shuffle partitions that each holds about
    ``target_partition_bytes`` of the input (so a full shuffle of the big
    table fits executor memory and spills little), and lets AQE coalesce
    partitions that turn out small. For 100 TB this gives about 400,000
    initial partitions, coalesced to what the shuffle actually writes.
    """
    partitions = max(200, -(-input_bytes // target_partition_bytes))
    return {
        **RECOMMENDED_CONF,
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.files.maxPartitionBytes": str(min(target_partition_bytes, 512 * 1024 * 1024)),
    }


def configure(spark: SparkSession) -> SparkSession:
    """Fill in the settings of RECOMMENDED_CONF that the session leaves unset."""
    for key, value in RECOMMENDED_CONF.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "patronage") -> SparkSession:
    """A local session for tests and the benchmark: no UI, UTC, AQE on."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Python call-site capture for error messages: a few JVM calls per
        # DataFrame call; off for tests and the benchmark
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in RECOMMENDED_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
