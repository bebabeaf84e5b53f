"""What the operators share: tables in the shared folder, and small expressions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARED_DIR = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it.

    Only a single-machine session may lack the setting; it then gets a folder of
    its own, which it keeps for the session.
    """
    found = spark.conf.get(SHARED_DIR, None) or spark.sparkContext.getConf().get(SHARED_DIR, None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{SHARED_DIR} must name a folder that all executors share")
    made = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
    spark.conf.set(SHARED_DIR, made)
    return made


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it back: cuts the
    lineage, and a lost executor costs no earlier stage."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_mod(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids give null."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


def crc32_sql(text: str) -> str:
    """DuckDB SQL of the unsigned crc32 of a text expression's UTF-8 bytes; the table follows from the polynomial."""
    table = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        table.append(i)
    half = lambda at: f"(instr('0123456789ABCDEF', substr(s, {at}, 1)) - 1)"
    octets = f"list_transform([hex(encode({text}))], lambda s: list_transform(range(1, length(s) + 1, 2), lambda k: 16 * {half('k')} + {half('k + 1')}))[1]"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::bigint, {octets}), lambda c, b: xor(c >> 8, {table}[1 + (xor(c, b) & 255)]::bigint)))"
