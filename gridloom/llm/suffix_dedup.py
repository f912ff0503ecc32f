"""Removal of long byte strings that occur more than once, by distributed prefix doubling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import discard, release, staged
from gridloom.llm.repeats import CODES, Units, digests, removal, run_columns

#: Bytes at an anchor; with WIDTH it makes strings of GRAM + WIDTH - 1 = 400 bytes.
GRAM, WIDTH = 145, 256
#: Windows in a block of the filter before ranking: common parts of 385 bytes.
SIZES = (16,)
#: Bytes of the first rank; offsets double from here until the rank is that of the whole string.
FIRST = 100


def offsets_of(length: int, first: int) -> list[int]:
    """By how many bytes each round lengthens the ranked strings."""
    steps, k = [], min(first, length)
    while k < length:
        steps.append(min(k, length - k))
        k += steps[-1]
    return steps


def positions(held: DataFrame, length: int, first: int) -> DataFrame:
    """Positions of each text (uid, text, runs) that the rounds need: (uid, pos, a, b, n, own, code, check).

    Where a string of ``length`` bytes may repeat, ``code`` tells its context and place, ``own`` how many such
    places it stands for, and ``check`` is a cryptographic digest of it; the others (``code`` -1) are the places whose ranks
    become second halves. ``a`` names the ``first`` bytes from ``pos``, by hash; ``b`` is 0 as yet.
    """
    reach = {0}
    for step in offsets_of(length, first):
        reach |= {r + step for r in reach}
    names = ["uid", "pos", "a", "b", "n", "own", "code", "check"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uid, text, runs in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                cid, _, at, low, high, n = run_columns(runs)
                count = high - low + 1
                of = np.repeat(np.arange(len(at)), count)
                lo = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + low[of]
                start, n = at[of] - lo, n[of]
                pos = np.unique(np.concatenate([start + r for r in reach]))
                most, own, check = (np.zeros(len(pos), np.int64) for _ in range(3))
                for r in reach:
                    np.maximum.at(most, np.searchsorted(pos, start + r), n)
                code = np.full(len(pos), -1, np.int64)
                here = np.searchsorted(pos, start)
                data = text.as_py().encode()
                u = Units(data, False)
                own[here], code[here] = n, cid[of] * CODES + lo
                check[here] = digests(data, start, start + length)
                name = u.hashes[0].of(pos, pos + min(first, length)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.full(len(pos), uid), pos, name, np.zeros(len(pos), np.int64), most, own, code, check)], names)

    return held.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def reranked(rows: DataFrame) -> DataFrame:
    """``rows`` with their rank in the order of the pairs (a, b). Pairs of one place only have no copy: their rows drop out.

    Pairs are counted before they are shuffled, sorted by Spark in ranges, and numbered in that
    order, with gaps between ranges; a pair of many rows is one row of the sort.
    """
    shared = rows.groupBy("a", "b").agg(F.sum("n").alias("total")).filter("total > 1").select("a", "b")
    ranks = shared.orderBy("a", "b").withColumn("rank", F.monotonically_increasing_id())
    return rows.join(ranks, ["a", "b"]).drop("a", "b")


def doubled(held: DataFrame, length: int, first: int = FIRST) -> DataFrame:
    """The strings of ``length`` bytes in the runs of ``held`` that start at more than one place: (cid, lo, hi), each alone.

    Prefix doubling: positions are ranked by their first bytes; then the pair of the ranks at a
    position and ``step`` bytes on is ranked in turn, for growing offsets, until the rank is that of the whole
    string. A position whose rank is its own drops out, and with it those whose second half it was.
    """
    rows = staged(positions(held, length, first), "suffix-positions")
    for step in offsets_of(length, first):
        ranks = staged(reranked(rows), "suffix-ranks")
        discard(rows)
        release(held.sparkSession)
        far = ranks.select("uid", (F.col("pos") - step).alias("pos"), F.col("rank").alias("b"))
        rows = staged(ranks.withColumnRenamed("rank", "a").join(far, ["uid", "pos"]), "suffix-pairs")
        discard(ranks)
        release(held.sparkSession)
    own = rows.filter("code >= 0")
    # the last rank need not be numbered; it is held against the digest of the whole string
    by = ["a", "b", "check"]
    found = own.join(own.groupBy(*by).agg(F.sum("own").alias("total")).filter("total > 1"), by)
    return found.select(F.shiftright("code", 8).alias("cid"), (F.col("code") % CODES).cast("int").alias("lo")).withColumn("hi", F.col("lo"))


def suffix_dedup(docs: DataFrame, gram: int = GRAM, width: int = WIDTH, sizes: tuple[int, ...] = SIZES, first: int = FIRST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove each byte covered by a string of gram + width - 1 bytes that also starts anywhere else.

    A filter goes before the ranks: each string holds an anchor of ``gram`` bytes, at the same place in all its
    copies, and only around anchors that occur more than once can strings repeat; anchors with one and the
    same surroundings everywhere (plain copies) are decided by that, and so are blocks of ``sizes`` neighbouring
    strings whose common part is unique or whose surroundings agree. All other positions are ranked by
    prefix doubling (``doubled``). First ranks name 100 bytes by a 64-bit hash, and a string's last
    rank counts only where a 64-bit cryptographic digest of the whole string agrees too.

    Whole texts as UTF-8 bytes; null is empty; strings never cross rows; copies count, in the same
    text or another, and repeated rows are copies. Texts shorter than the string keep all bytes. Null ids
    return as null; ids are whole numbers. Other columns are not read; an empty table gives no rows.

    Returns id, n_bytes, n_removed, n_spans, kept_sha256.
    """
    length = gram + width - 1
    return removal(docs, False, gram, width, sizes, "suffix", id_col, text_col, lambda held: doubled(held, length, first)).withColumnRenamed("n_units", "n_bytes")


def op10_suffix_dedup(spark, sf_dir):
    """All documents without strings of 400 bytes that repeat; see ``suffix_dedup``."""
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
