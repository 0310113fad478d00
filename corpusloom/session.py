"""SparkSession factory with the settings the plans rely on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "corpusloom", cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Local session for tests and benches; on a cluster, submit with your own master and call this with no arguments."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


#: Bytes of a table up to which it is worth a shuffle to have it on all cores.
SPREAD_BYTES = 1 << 30


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, if it is small and read in fewer splits than there are cores: a file of one row group is read by one task.

    Larger inputs are left as they are: their splits are work enough for a task each.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= SPREAD_BYTES and df._jdf.rdd().getNumPartitions() < cores else df
