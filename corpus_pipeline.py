"""A corpus pipeline: toxic documents go, copies and near copies go, sources are mixed, the rest is packed.

For all stages: null texts are empty, texts of any length go through whole, an empty table gives an empty result. The first four return
the columns of their input as they are, whatever their names; ids are whole numbers or null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import exact_dedup, minhash, mixing, packing, toxicity
from gridloom.llm.common import LOWER, UPPER, kept_rows, staged, text_of
from gridloom.llm.tokens import tokenizer_path


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from this stage's input, doesn't reject.

    Repeated rows and rows with equal text share a score, and so their fate. Rows without a label are scored too.
    """
    return toxicity.without_toxic(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts equal but for the case of A-Z: the one with the largest id.

    Null ids come last in the choice; of repeated rows (equal id and text) exactly one stays. Empty and null texts are one group.
    """
    kept = exact_dedup.exact_dedup(docs).filter("kept").select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("key"))
    return kept_rows(docs, kept, F.sha2(F.translate(text_of(), UPPER, LOWER).cast("binary"), 256))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies (five words, similarity of 0.8 or more); ties and null ids as ``minhash.near_dedup`` states."""
    kept = minhash.near_dedup(docs).filter("kept").select(F.col("doc_id").alias("id"), F.col("text_hash").alias("key"))
    return kept_rows(docs, kept, F.xxhash64(text_of()))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: whole documents, once or more, or not at all. A null source is a source of its own, the last."""
    return mixing.drawn(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in sequences of 2048 tokens."""
    pieces = staged(packing.token_pieces(docs, tokenizer_path("byte_bpe_50k.json")), "packing")
    return packing.pack(pieces).select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", F.col("sequence_id").cast("long"), F.col("offset").cast("long"))


STAGES = [("toxicity", toxic), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mix), ("packing", pack)]
#: SQL expresses neither the model nor the sketches.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in a row over the whole table, each one's result written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
