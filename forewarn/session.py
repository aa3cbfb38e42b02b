"""Session settings the long projections want; all can be changed at run time."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # A fused stage over some hundred formulas becomes one method of more than 8000
    # bytecodes, which the JVM never compiles.  Past that size Spark now uses its
    # per-operator code, which it splits into small methods (5-6x faster here).
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # hot keys in joins are split at run time
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local(cpus: str | int = "*", shuffle_partitions: int = 8, app: str = "forewarn") -> SparkSession:
    """A local session for tests and benchmarks."""
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName(app)
             .config("spark.sql.shuffle.partitions", shuffle_partitions)
             .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             # small test files still make a split for every core
             .config("spark.sql.files.maxPartitionBytes", "1m").config("spark.sql.files.openCostInBytes", "64k")
             # no call-site capture per column expression: halves the time to build long plans
             .config("spark.python.sql.dataFrameDebugging.enabled", "false")
            .config("spark.driver.memory", "12g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)
