"""Tables between the steps of a plan, in the folder that driver and executors share; and numbering in a global order."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The shared folder: spark.checkpoint.dir. A temporary one only where that isn't set and all runs on one machine; elsewhere that is an error."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or getattr(spark, "_loom_steps", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = spark._loom_steps = "file://" + tempfile.mkdtemp(prefix="loom-")
    return path.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str, few_files: bool = False) -> DataFrame:
    """df, written to the shared folder and read back: its lineage is cut, it isn't computed again, and it survives the loss of executors.

    few_files: rebalances thin rows first, so that there are as many files as their size asks for, not one for each task of a wide stage.
    """
    path = fresh_path(df.sparkSession, tag)
    (df.hint("rebalance") if few_files else df).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._loom_path = path
    return out


def shuffled_side(df: DataFrame) -> DataFrame:
    """df as a side of a join that is to be shuffled, whatever its size is taken for: a written table of ids or word sets may be twenty times as large in memory as on disk, and a broadcast has it in the driver."""
    return df.hint("merge")


def removed(df: DataFrame) -> None:
    """Deletes a table that written() wrote and that nothing reads any more."""
    path = getattr(df, "_loom_path", None)
    if path:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Bits of monotonically_increasing_id() that are a row's place in its partition.
PLACE_BITS = 33


def numbered(rows: DataFrame, order: list[str | Column], name: str, parts: int | None = None) -> DataFrame:
    """rows with a long `name`: how many rows come before in the order of these columns, ties in any. Ranges are dealt to partitions; the driver sees a count of each.

    Ranges are sorted where they are dealt to and written with each row's place, so rows are shuffled once. parts: how many ranges, if not as many as Spark takes.
    """
    dealt = rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)
    placed = written(dealt.sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", PLACE_BITS)
    starts, before = [], 0
    for r in placed.groupBy(part.alias("_part")).count().orderBy("_part").collect():
        starts += [F.lit(r["_part"]), F.lit(before)]
        before += r["count"]
    if not starts:
        return rows.withColumn(name, F.lit(0).cast("long"))
    within = F.col("_at").bitwiseAND((1 << PLACE_BITS) - 1)
    return placed.withColumn(name, (F.create_map(*starts)[part] + within).cast("long")).drop("_at")
