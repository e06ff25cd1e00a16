"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Up to so many rows of ids and small numbers are broadcast; beyond, the join shuffles.
MAX_IDS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket(mod: int) -> Column:
    """crc32 of doc_id as text, modulo mod."""
    return F.crc32(F.col("doc_id").cast("string")) % mod


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words(c: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), SPACE), lambda w: w != "")


def utf8(t: str | bytes | None) -> bytes:
    return t if isinstance(t, bytes) else (t or "").encode("utf-8", "surrogatepass")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names; one of our own only where none is set and all tasks run in this process, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="verdant-")


def cut(df: DataFrame, *spent: DataFrame) -> DataFrame:
    """Write df in the shared folder and read it again: the lineage ends there and a lost executor costs no rework.

    spent: earlier results of cut that nothing but df needs; their files go once df is written.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_folder"] = path
    drop(*spent)
    return out


def drop(*spent: DataFrame) -> None:
    """Delete the files of results of cut that are not read any more."""
    for old in spent:
        path = old.sparkSession._jvm.org.apache.hadoop.fs.Path(old.__dict__["_folder"])
        path.getFileSystem(old.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def bounded(ids: DataFrame, most: int = MAX_IDS) -> DataFrame:
    """ids with a broadcast hint where they are at most so many, counted; ids should be cheap to read twice."""
    return F.broadcast(ids) if ids.count() <= most else ids


def only(rows: DataFrame, key: str, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows whose key is among the distinct values of the one column of ids."""
    ids = ids.toDF("_verdant_key")
    return rows.join(bounded(ids), F.col(key) == F.col("_verdant_key"), how)


def without(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The other rows, those with a null key among them."""
    return only(rows, key, ids, "left_anti")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Keep Arrow batches of whole texts small: some texts have many thousand words. Holds for the session from then on."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def number(df: DataFrame, part: list[str], order: list[str]) -> DataFrame:
    """df with k, the place (from 0) of each row within its part by `order` (nulls first), and n, the rows of the part.

    Rows are range-sorted by part and order, so a part of any size is spread over tasks; only counts of (part, task) are summed. Rows
    equal in part and order may swap places.
    """
    keys = [*part, *order]
    d = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_m", F.monotonically_increasing_id())
    d = cut(d.withColumn("_p", F.shiftright("_m", 33)))
    w = Window.partitionBy(*(part or [F.lit(0)]))
    runs = d.groupBy(*part, "_p").agg(F.min("_m").alias("_first"), F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(w.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(*[F.col(c).alias(f"_part_{c}") for c in part], F.col("_p").alias("_run"), "_first", before.alias("_before"), F.sum("_c").over(w).alias("n"))
    same = F.col("_p") == F.col("_run")
    for c in part:
        same &= F.col(c).eqNullSafe(F.col(f"_part_{c}"))
    out = d.join(bounded(runs), same)
    out = out.select(*df.columns, (F.col("_m") - F.col("_first") + F.col("_before")).alias("k"), "n")
    out.__dict__["_folder"] = d.__dict__["_folder"]
    return out
