"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SHARED_DIR = "spark.checkpoint.dir"
#: Rows of a group up to which one task numbers them.
WITHIN = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """As the cluster names it; a single-machine session without the setting gets a folder
    of its own."""
    found = spark.conf.get(SHARED_DIR, None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{SHARED_DIR} must name a folder that all executors share")
    made = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
    spark.conf.set(SHARED_DIR, made)
    return made


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unpacked(df: DataFrame) -> DataFrame:
    """df whose rows, and what is made of them row by row, are never broadcast. Lists take
    little room in files, by which Spark would take many times as many rows as they hold for
    a small table, and build it in the driver."""
    return df.hint("merge")


def few(df: DataFrame) -> DataFrame:
    """df, a row for each of the few large groups, sent to all tasks: a shuffle by group would
    bring each large group into one."""
    return F.broadcast(df)


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """df with its rows numbered from 0 in the given order, without bringing them into one
    task: ranges are numbered by themselves, after the number of rows before each."""
    spark = df.sparkSession
    ranges = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("_range", F.spark_partition_id())
    ranges = saved(ranges, "numbered")
    sizes = {r["_range"]: r["n"] for r in ranges.groupBy("_range").agg(F.count("*").alias("n")).collect()}  # one a range
    if not sizes:
        return ranges.drop("_range").withColumn(name, F.lit(0).cast("long"))
    before, total = [0] * (max(sizes) + 1), 0
    for r in range(max(sizes) + 1):
        before[r], total = total, total + sizes.get(r, 0)
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return ranges.withColumn(name, (within + F.array(*map(F.lit, before))[F.col("_range")]).cast("long")).drop("_range")


def numbered_within(df: DataFrame, name: str, group: str, *order: str | Column, over: int = WITHIN) -> DataFrame:
    """df with the rows of each group numbered from 0 in the given order. Groups of more than
    `over` rows are numbered over ranges, others where they lie, without writing their rows."""
    large = few(saved(df.groupBy(group).agg(F.count("*").alias("_n")).where(F.col("_n") > over).select(group), "large"))
    alone = lambda rows: rows.withColumn(name, (F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1).cast("long"))
    if large.isEmpty():
        return alone(df)
    return alone(df.join(large, group, "left_anti").select(*df.columns)).union(numbered_over_ranges(df.join(large, group, "left_semi").select(*df.columns), name, group, *order))


def numbered_over_ranges(df: DataFrame, name: str, group: str, *order: str | Column) -> DataFrame:
    """numbered_within for large groups: each lies in several ranges, which are numbered by
    themselves after the rows of its group in those before."""
    ranges = saved(df.repartitionByRange(group, *order).withColumn("_range", F.spark_partition_id()), "numbered")
    sizes = ranges.groupBy(group, "_range").agg(F.count("*").alias("_n"))
    # One row a group and range: as many as there are groups and ranges together.
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_range")) - F.col("_n")
    within = F.row_number().over(Window.partitionBy(group, "_range").orderBy(*order)) - 1
    starts = sizes.withColumn("_before", before).where("_before > 0").select(group, "_range", "_before")
    placed = ranges.withColumn("_within", within).join(starts, [group, "_range"], "left")
    return placed.withColumn(name, (F.col("_within") + F.coalesce("_before", F.lit(0))).cast("long")).select(*df.columns, name)
