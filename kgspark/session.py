"""Sessions with the settings that the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# In Spark 4.1 a union may take over its children's partitioning while adaptive execution coalesces
# each child in its own way; a group or join above it then misses its exchange.
REQUIRED = {"spark.sql.unionOutputPartitioning": "false", "spark.sql.session.timeZone": "UTC"}

PARTITION = 2 << 20  # bytes of input for each shuffle partition
ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"


def session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session, for tests and benchmarks; on a cluster pass your own to ``prepare``."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("kgspark").config("spark.sql.shuffle.partitions", shuffle_partitions).config("spark.ui.enabled", "false").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings that right results need."""
    for key, value in REQUIRED.items():
        spark.conf.set(key, value)
    return spark


def sized(spark: SparkSession, paths: list[str]) -> None:
    """Shuffles of the session in partitions that do not grow with these inputs; adaptive execution joins those that are small."""
    system = spark._jvm.org.apache.hadoop.fs.Path
    size = 0
    for path in map(system, paths):
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if files.exists(path):
            size += files.getContentSummary(path).getLength()
    needed = -(-size // PARTITION)
    if needed > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set("spark.sql.shuffle.partitions", needed)
    if spark.conf.get(ADVISORY) == "67108864b":  # Spark's own value
        spark.conf.set(ADVISORY, "8m")
