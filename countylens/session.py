"""Session settings the jobs are meant to run with."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Adaptive execution sizes shuffle partitions, turns small shuffled sides into broadcasts and
# splits hot join keys at run time.
CLUSTER_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.shuffle.partitions": "8000",
    "spark.sql.session.timeZone": "UTC",
}


def cluster_session(app: str = "countylens", conf: dict[str, str] | None = None) -> SparkSession:
    """A session on the cluster that spark-submit names."""
    return SparkSession.builder.config(map=CLUSTER_CONF | (conf or {})).appName(app).getOrCreate()


def local_session(cores: str = "8", app: str = "countylens", memory: str = "8g",
                  conf: dict[str, str] | None = None) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    spark = (SparkSession.builder.config(map=conf or {}).master(f"local[{cores}]").appName(app)
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", memory)
             .config("spark.sql.shuffle.partitions", "8")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.sql.adaptive.enabled", "true")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: the one the cluster names, else one in the warehouse.

    On a cluster a warehouse on a local disk is seen by one machine only, and refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    path = spark._jvm.org.apache.hadoop.fs.Path(warehouse)
    local = path.getFileSystem(spark._jsc.hadoopConfiguration()).getScheme() == "file"
    if local and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set spark.checkpoint.dir: the warehouse {warehouse} is a folder of one machine")
    return f"{warehouse}/work"
