"""Sequences and alignments made from business tables: an order's line flags, a user's
events, a document's words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import saved, unpacked


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_ord(sequences: DataFrame) -> DataFrame:
    """Number the sequences of a group by their ids, as strings."""
    return sequences.withColumn("ord", (F.row_number().over(Window.partitionBy("group_id").orderBy("sequence_id")) - 1).cast("int"))


def order_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(group_id, sequence_id, ord, letters): a customer's orders, lettered by the return
    flags of their lines. Written once, as most queries read them several times."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    lettered = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_returnflag"))).alias("lines"))
    joined = orders.join(lettered, orders.o_orderkey == lettered.l_orderkey)
    return unpacked(saved(with_ord(joined.select(
        F.col("o_custkey").cast("string").alias("group_id"), F.col("l_orderkey").cast("string").alias("sequence_id"),
        F.transform("lines", lambda x: x["l_returnflag"]).alias("letters"),
    )), "sequences"))


def event_sequences(spark: SparkSession, sf_dir: str, groups: int = 10) -> DataFrame:
    """A user's event types in order of time; users are grouped by id modulo `groups`.
    Written once, as order_sequences."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    lettered = events.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("events"))
    return unpacked(saved(with_ord(lettered.select(
        (F.col("user_id") % groups).cast("string").alias("group_id"), F.col("user_id").cast("string").alias("sequence_id"),
        F.transform("events", lambda x: x["event_type"]).alias("letters"),
    )), "sequences"))


def explode_residues(sequences: DataFrame) -> DataFrame:
    """(group_id, sequence_id, pos, letter), positions from 0."""
    return sequences.select("group_id", "sequence_id", F.posexplode("letters").alias("pos", "letter"))


def column_name(sequence_id: Column, pos: Column) -> Column:
    return F.concat_ws(":", sequence_id, pos.cast("string"))


def named_columns(placed: DataFrame, *keys: str) -> DataFrame:
    """(aln_id, column_id, sequence_id, pos) of residues that share (aln_id, *keys): a
    column is named for its least residue."""
    by = Window.partitionBy("aln_id", *keys)
    least = F.min(F.struct("sequence_id", "pos")).over(by)
    return placed.withColumn("_least", least).select("aln_id", column_name(F.col("_least.sequence_id"), F.col("_least.pos")).alias("column_id"), "sequence_id", "pos")


def justified(sequences: DataFrame, left: bool = True) -> DataFrame:
    """Columns of the alignment that sets the sequences of a group flush left or right."""
    rows = sequences.select(F.col("group_id").alias("aln_id"), "sequence_id", F.size("letters").alias("_n"), F.posexplode("letters").alias("pos", "letter"))
    return named_columns(rows.withColumn("_at", F.col("pos") if left else F.col("pos") - F.col("_n")), "_at")
