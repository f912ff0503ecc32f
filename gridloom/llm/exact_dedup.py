"""Exact dedup by a tree-merge of digest runs. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import LOWER, UPPER, staged, text_of

#: What tells equal texts: SHA-256, checked by the length and a second digest of another family.
KEY = ["digest", "n_bytes", "check"]
#: Digests that a partition of a merge is to hold, about, and ranges of digests to a partition (which evens partitions out).
PART_ROWS, FINER = 1_000_000, 4
#: Rows of a run, about; and the least number of runs.
RUN_ROWS, RUNS = 4_000_000, 64


def merged(rows: DataFrame, retain: str) -> DataFrame:
    """Equal digests of a run (and range) as one row: the row to retain, and the sum of the counts. Of equal identifiers the first row stays."""
    if retain == "smallest":
        best = F.min(F.struct(F.col("keep_id").isNull().alias("known"), "keep_id", F.col("keep_row").alias("row")))
    else:
        best = F.max(F.struct(F.col("keep_id").isNotNull().alias("known"), "keep_id", (-F.col("keep_row")).alias("row")))
    found = rows.groupBy("run", "part", *KEY).agg(best.alias("best"), F.sum("group_size").alias("group_size"))
    return found.select("run", "part", *KEY, "best.keep_id", F.abs("best.row").alias("keep_row"), "group_size")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int | None = None, parts: int | None = None, retain: str = "largest") -> DataFrame:
    """Groups of equal texts; of each group the row with the largest identifier stays (or with ``retain`` "smallest").

    Texts are equal when identical after lower-casing A-Z only; a null text is empty.

    Rows are dealt to ``runs`` runs, a power of two that grows with the rows. A run is sorted by digest, in ``parts`` ranges of
    digests that merge apart from each other and grow with the rows too; it holds each of its digests once, with
    the row to retain and a count. In each binomial round neighbouring runs 2 r and 2 r + 1 exchange their sorted digests and
    merge them to run r, until one is left. So a group of copies that holds most rows is
    spread over ``runs`` partial results, then half as many, and so on. Merges compare SHA-256, the byte length and a second
    digest, so what is retained is verified at every level. Each level is written to the shared folder; the decision then walks
    the same tree downwards, keyed by digest and run again, so no join has a hot key.

    Returns one row per input row: id, keep_id, group_size, kept, text_sha256.
    Repeated rows (equal id and text): exactly one is kept. Null ids come after all others in the choice; a group of
    null ids has a null keep_id and keeps one row. An empty table gives an empty result; texts of any length go through whole, as digests
    alone are moved. Other columns are not read, whatever their names.
    """
    norm = F.translate(text_of(text_col), UPPER, LOWER)
    rows = docs.select(F.col(id_col).alias("id"), norm.alias("norm")).select(
        "id", F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("digest"), F.octet_length("norm").cast("long").alias("n_bytes"), F.xxhash64("norm").alias("check"), F.monotonically_increasing_id().alias("row")
    )
    rows = staged(rows, "digests")  # the numbers of rows stay as written
    total = rows.count()
    runs = runs or max(RUNS, 1 << (total // RUN_ROWS).bit_length())
    partitions = max(8, 2 * rows.sparkSession.sparkContext.defaultParallelism, -(-total // PART_ROWS))
    parts = parts or max(64, FINER * -(-total // PART_ROWS))
    # the range of a digest among all, by its first four bytes
    leaves = rows.withColumn("run", F.pmod(F.xxhash64(F.lit(8), "row"), F.lit(runs)).cast("int")).withColumn("part", F.floor(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long") * parts / (1 << 32)).cast("int"))
    level = leaves.select("run", "part", *KEY, F.col("id").alias("keep_id"), F.col("row").alias("keep_row"), F.lit(1).cast("long").alias("group_size"))
    levels, width = [staged(merged(level, retain), "runs")], runs
    while width > 1:
        width = -(-width // 2)
        pairs = levels[-1].withColumn("run", F.shiftright("run", 1)).repartition(partitions, "run", "part").sortWithinPartitions("run", "part", *KEY)
        levels.append(staged(merged(pairs, retain), "runs"))
    decided = levels.pop()
    while levels:
        below = levels.pop().select(*KEY, F.col("run").alias("own"), F.shiftright("run", 1).alias("run"))
        decided = below.join(decided.drop("part"), [*KEY, "run"]).drop("run").withColumnRenamed("own", "run")
    return leaves.drop("part").join(decided, [*KEY, "run"]).select(F.col("id").alias(id_col), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op8_exact_dedup(spark, sf_dir):
    """Every document's group of equal texts, for the whole table; see ``exact_dedup``."""
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = f"""
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents)
WINDOW g AS (PARTITION BY norm)
"""
