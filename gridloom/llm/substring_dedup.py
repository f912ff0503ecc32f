"""Removal of long word sequences that occur more than once, by compaction of a De Bruijn graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import release, staged
from gridloom.llm.repeats import CODES, Units, digests, joined_words, removal, run_columns

#: Words of the first filter; with WIDTH it makes windows of GRAM + WIDTH - 1 = 35 words.
GRAM, WIDTH = 8, 28


def edges_of(held: DataFrame, length: int) -> DataFrame:
    """One row for each window in the runs of each text (uid, text, runs): (code, n, edge, check, tail, head).

    ``edge`` and ``check`` name the window, by a polynomial and by a cryptographic digest of its
    words; ``tail`` and ``head`` name its first and last length - 1 words, the nodes that it joins.
    """
    names = ["code", "n", "edge", "check", "tail", "head"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, runs in zip(b.column(1), b.column(2), strict=True):
                cid, _, at, low, high, n = run_columns(runs)
                count = high - low + 1
                of = np.repeat(np.arange(len(at)), count)
                lo = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + low[of]
                start = at[of] - lo
                data = joined_words(text.as_py().encode())
                u = Units(data, words=True)
                name = lambda a, z: u.hashes[0].of(start + a, start + z).view(np.int64)  # noqa: B023, E731
                check = digests(data, u.starts[start], u.ends[start + length - 1])
                cols = cid[of] * CODES + lo, n[of], name(0, length), check, name(0, length - 1), name(1, length)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)

    return held.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def placed(edges: DataFrame) -> DataFrame:
    """(e, path, place): the path of each edge (e, tail, head) and its place there, where a path is named by its first edge.

    One edge follows another if the node between them has no other repeated edge in or out. Pointers
    to the edge before double, by joins, until they reach the first edge of their path: after k rounds paths of 2^k
    edges stand. Only pointers that haven't arrived are joined, and no two of them lead to one edge, so no key is
    hot. When a round brings no edge home, those still under way are on closed rings; each of them stays a path of its own.
    """
    out = edges.groupBy(F.col("tail").alias("node")).agg(F.count("*").alias("outs"), F.min("e").alias("e")).filter("outs = 1").drop("outs")
    into = edges.groupBy(F.col("head").alias("node")).agg(F.count("*").alias("ins"), F.min("e").alias("path")).filter("ins = 1").drop("ins")
    links = out.join(into, "node").select("e", "path", F.lit(1).cast("long").alias("place"))
    links = edges.select("e").join(links, "e", "left")
    links = links.select("e", F.coalesce("path", "e").alias("path"), F.coalesce("place", F.lit(0).cast("long")).alias("place"), F.col("path").isNull().alias("home"))
    links = staged(links, "paths-links")
    left = links.filter("not home").count()
    while left:
        on = links.select(F.col("e").alias("path"), F.col("path").alias("further"), F.col("place").alias("more"), F.col("home").alias("there"))
        away = links.filter("not home").drop("home").join(on, "path")
        away = away.select("e", F.col("further").alias("path"), (F.col("place") + F.col("more")).alias("place"), F.col("there").alias("home"))
        links = staged(links.filter("home").unionByName(away), "paths-links")
        release(edges.sparkSession)
        before, left = left, links.filter("not home").count()
        if left == before:
            break
    ring = ~F.col("home")
    return links.select("e", F.when(ring, F.col("e")).otherwise(F.col("path")).alias("path"), F.when(ring, 0).otherwise(F.col("place")).alias("place"))


def compacted(held: DataFrame, length: int) -> DataFrame:
    """Repeated windows in the runs of ``held`` (uid, text, runs), as runs of windows (cid, lo, hi).

    Distinct windows that occur more than once are the edges of the graph, each with the coordinates of its
    first occurrence, which name it. Nonbranching paths of edges compact (``placed``); then every occurrence is
    put on its path, and occurrences of one context that keep step with the path make one run. The
    coordinates are held against the number of windows: a run with a gap falls back to its single windows.
    """
    rows = staged(edges_of(held, length), "paths-windows")
    by = ["edge", "check"]
    first = F.min(F.struct("code", "tail", "head"))
    edges = rows.groupBy(*by).agg(F.sum("n").alias("total"), first.alias("first")).filter("total > 1")
    edges = staged(edges.select(*by, F.col("first.code").alias("e"), "first.tail", "first.head"), "paths-edges")
    paths = staged(edges.select("e", *by).join(placed(edges.select("e", "tail", "head")), "e").drop("e"), "paths-places")
    release(held.sparkSession)
    at = rows.select("code", *by).join(paths, by).select(F.shiftright("code", 8).alias("cid"), (F.col("code") % CODES).cast("int").alias("lo"), "path", "place")
    runs = at.groupBy("cid", "path", (F.col("place") - F.col("lo")).alias("shift")).agg(F.min("lo").alias("lo"), F.max("lo").alias("hi"), F.collect_list("lo").alias("all"))
    whole = F.size("all") == F.col("hi") - F.col("lo") + 1
    runs = runs.select("cid", F.explode(F.when(whole, F.array(F.struct("lo", "hi"))).otherwise(F.transform("all", lambda x: F.struct(x.alias("lo"), x.alias("hi"))))).alias("run"))
    return runs.select("cid", "run.lo", "run.hi")


def substring_dedup(docs: DataFrame, gram: int = GRAM, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove each word covered by a window of gram + width - 1 words whose sequence also starts anywhere else.

    Windows are the edges of a De Bruijn graph: each joins the node of its first words to that of its last. A filter
    goes before the graph: every window holds an anchor of ``gram`` words, at the same place in all its copies, so only
    windows around anchors that occur more than once are edges; anchors with one and the same surroundings everywhere
    (plain copies) are one path without branches and are taken as such. Edges are counted, single ones drop
    out, nonbranching paths compact (``compacted``), and the paths' coordinates mark the words of every text.
    Windows are equal where a 64-bit hash and a 64-bit cryptographic digest of their words are.

    Words are runs of anything but ASCII white space, unchanged; null texts have none; windows
    never cross rows; repeated rows are copies. Texts of fewer words than a window keep all. Null ids
    return as null; ids are whole numbers. Other columns are not read; an empty table gives no rows.

    Returns id, n_words, n_removed, n_spans, kept_sha256 (kept words joined by one space).
    """
    length = gram + width - 1
    return removal(docs, True, gram, width, (), "paths", id_col, text_col, lambda held: compacted(held, length)).withColumnRenamed("n_units", "n_words")


def op5_substring_dedup(spark, sf_dir):
    """All documents without windows of 35 words that repeat; see ``substring_dedup``."""
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("n_spans")
