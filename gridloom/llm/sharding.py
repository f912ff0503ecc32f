"""Proportional stratified interleaving into shards. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm.common import BUCKETS, running, staged, text_of


def stratified_shards(docs: DataFrame, shards: int = 40, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Deal rows to shards so that each shard has the corpus' mixture of sources and as many rows as any other.

    Equal texts are a unit, which counts for the least of its sources. Units of a source are shuffled by a
    seeded hash of the text and ranked by rows. A unit's fractional rank is (rows before it + half of its own) /
    rows of its source; sorted by that, every stretch of units has the mixture of the whole. A unit of several rows goes as
    a whole to the shard of its fractional rank, as long as such units fill no more than that shard's share and it
    is no more than a quarter of a shard. All other rows, in order of fractional rank, fill the
    shards up, so that row counts differ by one at most (law ``rows``); of these, only a unit that is too large, or
    for which its shard had no room, lies on several shards.

    Ranks come from two-level sums (see ``running``): no source, text or shard is one task.
    Null sources are a source of their own, the last; a null text counts as no bytes and has the CRC-32 of
    the empty string; repeated rows and null ids each get a slot; rows that tie in text and identifier are
    interchangeable. Other columns are not read. An empty table gives no rows.

    Returns id, size (UTF-8 bytes + 16), text_crc32, law, shard, slot, grown_shard (null: this law
    moves rows between old shards when one is added).
    """
    text = text_of(text_col)
    own = F.xxhash64(F.lit(seed + 1), F.col(id_col))
    rows = docs.select(
        F.col(id_col).alias("id"), F.struct(F.col(source_col).isNull().alias("none"), F.col(source_col).alias("source")).alias("source"), F.octet_length(text).cast("long").alias("bytes"), F.crc32(text.cast("binary")).alias("crc"),
        F.xxhash64(F.lit(seed), text).alias("h"), F.pmod(own, F.lit(BUCKETS)).cast("int").alias("bucket"), own.alias("own"),
    )
    rows = staged(rows, "shuffled")
    unit = ["h", "crc", "bytes"]
    # rows of a unit by bucket: a unit that holds most rows is spread out here and in all that follows
    parts = staged(rows.groupBy(*unit, "bucket").agg(F.count("*").alias("n"), F.min("source").alias("source")), "shard-parts")
    units = parts.groupBy(*unit).agg(F.sum("n").alias("n"), F.min("source").alias("source"))
    units = units.withColumn("bucket", F.shiftrightunsigned("h", 52).cast("int")).select(*unit, "n", "bucket", "source")
    counts = units.groupBy("source").agg(F.sum("n").alias("rows"))
    order = [F.col(c) for c in unit]
    ranked = running(units, ["source"], "bucket", order, F.col("n"), "rank").join(counts.withColumnRenamed("source", "of"), F.col("source") == F.col("of"))
    ranked = ranked.select(*unit, "n", ((F.col("rank") + F.col("n") / 2) / F.col("rows")).alias("frac"))
    ranked = staged(ranked.withColumn("bucket", F.floor(F.col("frac") * BUCKETS).cast("int")), "fractions")
    total = ranked.agg(F.sum("n")).first()[0] or 0
    ends = [-(-total * s // shards) for s in range(shards + 1)]  # shard s takes ends[s + 1] - ends[s] rows
    several = ranked.filter((F.col("n") > 1) & (F.col("n") <= total // shards // 4)).withColumn("shard", F.least(F.floor(F.col("frac") * shards), F.lit(shards - 1)).cast("int"))
    several = running(several, ["shard"], "bucket", [F.col("frac"), *order], F.col("n"), "first").filter(F.col("first") + F.col("n") <= total // shards)
    several = staged(several.select(*unit, "n", "shard", "first"), "shard-units")
    held = {r["shard"]: r["n"] for r in several.groupBy("shard").agg(F.max(F.col("first") + F.col("n")).alias("n")).collect()}
    free, starts = 0, [0]  # where each shard's part of the other rows begins
    for s in range(shards):
        free += ends[s + 1] - ends[s] - held.get(s, 0)
        starts.append(free)
    loose = ranked.join(several.select(*unit), unit, "left_anti")
    loose = running(loose, [], "bucket", [F.col("frac"), *order], F.col("n"), "first").select(*unit, F.lit(None).cast("int").alias("shard"), "first")
    placed = several.select(*unit, "shard", "first").unionByName(loose)
    # where the rows of each bucket of a unit begin
    by = W.partitionBy(*unit).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    begun = parts.withColumn("before", F.coalesce(F.sum("n").over(by), F.lit(0))).join(placed, unit).select(*unit, "bucket", "shard", (F.col("first") + F.col("before")).alias("first"))
    within = F.row_number().over(W.partitionBy(*unit, "bucket").orderBy("own", "id")) - 1
    every = rows.drop("source").withColumn("within", within).join(begun, [*unit, "bucket"]).withColumn("at", F.col("first") + F.col("within"))
    # the last shard whose part begins at or before this place; empty parts end where they begin
    of = F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in starts[1:-1]]), lambda x: x <= F.col("at"))) if shards > 1 else F.lit(0)
    begins = F.array(*[F.lit(x - held.get(s, 0)).cast("long") for s, x in enumerate(starts[:-1])])
    every = every.withColumn("of", F.coalesce("shard", of).cast("int")).withColumn("slot", F.when(F.col("shard").isNotNull(), F.col("at")).otherwise(F.col("at") - begins[F.col("of")]))
    return every.select(
        F.col("id").alias(id_col), (F.col("bytes") + 16).alias("size"), F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), F.col("of").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op4_sharding(spark, sf_dir):
    """All documents in 40 shards; see ``stratified_shards``."""
    return stratified_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
