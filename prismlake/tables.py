"""Reading the project's tables, picking current rows, and cutting lineage through the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Spark's setting by which an execution removes the files of its own shuffles at its end.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as named by spark.checkpoint.dir.

    Where it is unset, a temporary folder is taken, but only in local mode; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    found = tempfile.mkdtemp(prefix="prismlake-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def cut(df: DataFrame, name: str = "cut", partition_by: list[str] | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it again: lineage ends there and lost executors cost nothing."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    conf = df.sparkSession.conf
    before = conf.get(CLEAN_UP, None)
    conf.set(CLEAN_UP, "true")  # else the shuffle's files stay until the driver happens to collect its garbage
    try:
        writer.parquet(path)
    finally:
        conf.set(CLEAN_UP, before) if before is not None else conf.unset(CLEAN_UP)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found._cut_path = path
    return found


def discard(*tables: DataFrame) -> None:
    """Removes tables written by cut() that no pending plan reads any more; other frames are left alone."""
    for table_ in tables:
        path = getattr(table_, "_cut_path", None)
        if path:
            where = table_.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(table_.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def latest(df: DataFrame, key: str, stamp: str | None = None) -> DataFrame:
    """One row for each key: the one with the latest stamp (nulls last), or any one where repeated rows are equal.

    Rows with a null key are dropped. Rows of one key and stamp are equal by the reading rule.
    """
    df = df.where(F.col(key).isNotNull())
    if stamp is None:
        return df.dropDuplicates([key])
    rank = Window.partitionBy(key).orderBy(F.col(stamp).desc_nulls_last())
    return df.withColumn("_rank", F.row_number().over(rank)).where("_rank = 1").drop("_rank")


def numbered(rows: DataFrame, *order, position: str = "rank", total: str | None = None) -> DataFrame:
    """rows with their position (from 0) in an order, and their number, without ever bringing them to one task.

    Rows are sorted by range over the partitions; a position is that within the partition plus the sizes of those
    before. The order should end in a unique column, so that equal values can be spread.
    """
    at = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    at = cut(at.withColumn("_seq", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "numbered")
    sizes = at.groupBy("_part").agg(F.count("*").alias("_held"))  # one row a partition
    before = sizes.select("_part", F.coalesce(F.sum("_held").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_held").over(Window.partitionBy()).alias("_total"))
    found = at.join(F.broadcast(before), "_part").withColumn(position, F.col("_before") + F.col("_seq"))
    if total:
        found = found.withColumn(total, F.col("_total"))
    return found.drop("_part", "_seq", "_before", "_total")


def is_small(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows; stops counting there."""
    return df.limit(rows + 1).count() <= rows
