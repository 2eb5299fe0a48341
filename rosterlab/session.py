"""Session settings the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Sizes of join sides and skewed partitions are looked at while the query runs: a side is
# broadcast only when its measured size is under Spark's threshold, and a partition that one
# hot key blew up is split.
RUNTIME = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # A catalogue of some million units, cut to the columns a figure needs, stays below this,
    # which spares the slots a shuffle by unit. It bounds every broadcast.
    "spark.sql.autoBroadcastJoinThreshold": "64MB",
    # The driver builds each broadcast. Of stored rows only the size of their files is known when planning;
    # as a hash table they were seen to take more than ten times that.
    "spark.sql.sources.fileCompressionFactor": "32",
    # What one task reads, of files and of a shuffle, bounds what it sorts and adds up in memory.
    "spark.sql.files.maxPartitionBytes": "16MB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16MB",
}

# Partitions that a shuffle starts with; small ones are merged up to the advisory size.
INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
_OWN_INITIAL = "spark.rosterlab.initialPartitionNum"
INPUT_PER_PARTITION = 8 * 1024 * 1024


# Shuffled bytes per task: few enough to sort with little spill, enough that a shuffle of some
# terabytes stays at some ten thousand partitions.
BYTES_PER_TASK = 512 * 1024 * 1024


def sized_for(shuffled_bytes: int, cores: int) -> dict[str, str]:
    """Shuffle settings for a cluster job, from its largest shuffle and the cores it has.

    Count the bytes of the columns that are shuffled, not those of the tables. Partitions that
    turn out small are merged while running.
    """
    tasks = max(2 * cores, -(-shuffled_bytes // BYTES_PER_TASK))
    return {
        "spark.sql.shuffle.partitions": str(tasks),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(BYTES_PER_TASK // 2),
    }


def tune(spark: SparkSession) -> SparkSession:
    """Set what the caller's session leaves open; never override a setting that is there."""
    present = spark.conf.getAll
    for key, value in RUNTIME.items():
        if key not in present:
            spark.conf.set(key, value)
    return spark


def sized_by_input(spark: SparkSession, input_bytes: int) -> SparkSession:
    """Let shuffles start with partitions in proportion to the input, unless the caller set their number."""
    present = spark.conf.getAll
    if INITIAL not in present or present[INITIAL] == present.get(_OWN_INITIAL):
        least = int(spark.conf.get("spark.sql.shuffle.partitions"))
        for key in (INITIAL, _OWN_INITIAL):
            spark.conf.set(key, str(max(least, -(-input_bytes // INPUT_PER_PARTITION))))
    return spark


def local_session(cores: int | str = 8, name: str = "rosterlab", **extra: str) -> SparkSession:
    """Single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cores) if str(cores).isdigit() else "8")
    )
    for key, value in {**RUNTIME, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
