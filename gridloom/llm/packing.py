"""Best-two-fit packing of documents into sequences of bounded length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import BUCKETS, running, staged
from gridloom.llm.tokens import byte_ids, tokenizer_path

#: Texts tokenised at a time, so that a task's memory does not depend on its share of rows.
BATCH = 64


def token_pieces(docs: DataFrame, path: str, length: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut each document's ids, with ``end_id`` after them, into pieces of at most ``length`` ids.

    Only documents longer than ``length`` are cut: all their pieces are full, but for the first,
    which may be shorter. Null texts are empty and give a piece of one id. Repeated rows and null
    ids give pieces of their own. Returns row (unique to the document's row), id, piece, start, length, ids_crc32.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        from pyspark import TaskContext

        encoder = byte_ids(path)
        end = np.asarray([end_id], "<u4").tobytes()
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            for at in range(0, b.num_rows, BATCH):
                part = b.slice(at, BATCH)
                out = []
                for i, ids in zip(part.column(0).to_pylist(), encoder.batch([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    row += 1
                    ids = ids + end
                    n = len(ids) // 4
                    starts = [0, *range(n % length or length, n, length)]
                    out += [(row, i, k, s, e - s, zlib.crc32(ids[4 * s : 4 * e])) for k, (s, e) in enumerate(zip(starts, [*starts[1:], n], strict=True))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["row", "id", "piece", "start", "length", "ids_crc32"])

    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(cut, "row long, id long, piece int, start long, length long, ids_crc32 long")


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Bins as (how many, lengths in one) for ``counts`` of items by length, by best-two-fit.

    A bin is filled greedily with the longest item that fits. Then its smallest item gives way to
    two unpacked items that fill the widened gap more tightly, as long as such a pair exists. The
    bin so found is repeated as often as the counts allow, so the work depends on the number of
    different lengths, never on the number of items.
    """
    left = np.zeros(capacity + 1, np.int64)
    for n, c in counts.items():
        left[n] = c
    bins = []
    while left.any():
        used: list[int] = []
        gap = capacity
        free = left.copy()
        while gap and (fits := np.flatnonzero(free[: gap + 1])).size:
            free[fits[-1]] -= 1
            used.append(int(fits[-1]))
            gap -= used[-1]
        while gap and used:
            least = min(used)
            wide = gap + least
            free[least] += 1
            have = np.flatnonzero(free[: wide + 1])
            have = have[have > 0]
            # longest partner of each item that still fits; the item itself needs two of it
            mate = np.searchsorted(have, wide - have, side="right") - 1
            same = (mate >= 0) & (have[mate] == have) & (free[have] < 2)
            mate = np.where(same, mate - 1, mate)
            sums = np.where(mate >= 0, have + have[np.maximum(mate, 0)], 0)
            best = int(sums.argmax()) if sums.size else 0
            free[least] -= 1
            if not sums.size or sums[best] <= least:
                break
            a, b = int(have[best]), int(have[mate[best]])
            used.remove(least)
            used += [a, b]
            free[least] += 1
            free[a] -= 1
            free[b] -= 1
            gap = wide - a - b
        need = np.bincount(used, minlength=capacity + 1)
        times = int((left[need > 0] // need[need > 0]).min())
        left -= times * need
        bins.append((times, sorted(used, reverse=True)))
    return bins


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Give each piece (row, piece, length, ...) a ``sequence_id`` and its ``offset`` in that sequence.

    Pieces of one length are interchangeable, so bins are planned from the number of pieces of each
    length: at most ``capacity`` numbers, which is all that the driver sees. Pieces of a length are
    ranked by two-level sums and meet the plan, a table bounded by ``capacity`` alone, by length
    and range of ranks.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    plan, start, first = [], dict.fromkeys(counts, 0), 0
    for times, lengths in best_two_fit(counts, capacity):
        offset = 0
        for n in dict.fromkeys(lengths):
            k = lengths.count(n)
            plan.append((n, start[n], start[n] + times * k, k, first, offset))
            start[n] += times * k
            offset += n * k
        first += times
    table = spark.createDataFrame(plan, "p_length long, low long, high long, k long, bin long, at long")
    rows = pieces.withColumn("bucket", F.pmod(F.xxhash64("row", "piece"), F.lit(BUCKETS)).cast("int"))
    ranked = running(rows, ["length"], "bucket", [F.col("row"), F.col("piece")], F.lit(1), "rank").drop("bucket")
    here = ranked.join(F.broadcast(table), (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    order = F.col("rank") - F.col("low")
    return here.withColumn("sequence_id", F.col("bin") + F.floor(order / F.col("k"))).withColumn("offset", F.col("at") + (order % F.col("k")) * F.col("length")).drop("p_length", "low", "high", "k", "bin", "at", "rank")


def op7_best_fit_packing(spark, sf_dir):
    """All documents in sequences of 2048 tokens; see ``token_pieces`` and ``pack``."""
    pieces = staged(token_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path("byte_bpe_50k.json")), "packing")
    return pack(pieces).select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", F.col("sequence_id").cast("long"), F.col("offset").cast("long"))
