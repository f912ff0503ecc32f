"""Shared pieces of the corpus operators: staging tables, scalable ranks, names."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A word of the corpus contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Buckets of a two-level rank. Each bucket of a group is one window partition.
BUCKETS = 4096


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Set here only where it is unset and all of Spark is one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read back, which cuts its lineage.

    A lost executor loses none of it, and whatever reads it more than once sees the same rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove a staged table that nothing reads any more: all that came of it has been staged since."""
    jvm = df.sparkSession._jvm
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of steps whose results are staged by now."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(col: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def word_count(col: str = "text") -> Column:
    return F.regexp_count(text_of(col), F.lit(WORD)).cast("long")


def fraction(*cols: Column) -> Column:
    """A pseudorandom double in [0, 1), decided by the columns."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / float(1 << 53)


def running(df: DataFrame, group: list[str], bucket: str, order: list[Column], value: Column, into: str, buckets_sorted: bool = True) -> DataFrame:
    """Add ``into``: the sum of ``value`` over the rows before this one, in its group, by bucket and ``order``.

    No window covers a whole group: sums of buckets are added up first (at most one row for each
    bucket), then rows within a bucket. So a group that holds most of the rows is still spread out.
    """
    by = [*group, bucket]
    before = W.partitionBy(*group).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    sums = df.groupBy(*by).agg(F.sum(value).alias("__sum")).withColumn("__before", F.coalesce(F.sum("__sum").over(before), F.lit(0))).drop("__sum")
    within = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    left = df.withColumn("__within", F.coalesce(F.sum(value).over(within), F.lit(0)))
    sums = sums.select(*[F.col(c).alias(f"__r_{c}") for c in by], "__before")
    on = [left[c].eqNullSafe(sums[f"__r_{c}"]) for c in by]
    joined = left.join(sums, on)
    return joined.withColumn(into, (F.col("__within") + F.col("__before")).cast("long")).drop("__within", "__before", *[f"__r_{c}" for c in by])


def kept_rows(docs: DataFrame, kept: DataFrame, key: Column, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, all columns as they are, that ``kept`` (id, key, and times if not 1) names.

    ``key`` is what tells rows with one identifier apart. Of rows with equal identifier and key one stays.
    """
    none = F.lit(-(2**63))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(id_col).cast("long"), none).alias("id"), key.alias("key"))
    times = F.col("times") if "times" in kept.columns else F.lit(1)
    named = kept.select(F.coalesce(F.col("id").cast("long"), none).alias("id"), "key", times.alias("times")).filter("times > 0")
    nth = F.row_number().over(W.partitionBy("id", "key").orderBy("id", "key"))
    found = rows.join(named, ["id", "key"]).withColumn("nth", nth).filter("nth = 1")
    return found.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("row.*")
