"""Near-duplicate groups by order MinHash, verified by banded alignment."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm.common import fraction, release, staged, text_of
from gridloom.llm.repeats import NULL_ID, PrimeHashes, Units, mixed

#: Words in a shingle, similarity from which texts are near copies.
SHINGLE, SIMILARITY = 5, 0.8
#: Sketches of a text, and shingles in each. At similarity s a sketch agrees with probability of about s ** KEPT:
#: at 0.8 none of 24 does with probability 4e-8.
SKETCHES, KEPT = 24, 3
#: Shingles of texts that a task remembers while it verifies pairs (40 bytes each).
REMEMBERED = 3_000_000
#: Insertions and deletions from which an alignment goes by matches in place of diagonals.
WIDE = 400
#: Groups of shingles, by hash, in which two texts can share only as many as the one with fewer has.
GROUPS = 16
SALTS = np.random.default_rng(77).integers(0, 2**64, SKETCHES, np.uint64) | np.uint64(1)


def shingles(data: bytes, size: int = SHINGLE) -> np.ndarray:
    """A hash of each run of ``size`` words, in text order; a shorter text is one shingle."""
    u = Units(data, words=True, families=1)
    if not u.n:
        return np.zeros(0, np.uint64)
    at = np.arange(max(1, u.n - size + 1))
    return u.hashes[0].of(at, np.minimum(at + size, u.n))


def labelled(h: np.ndarray) -> np.ndarray:
    """The hashes with the number of the occurrence mixed in, so that repeated shingles differ."""
    order = np.argsort(h, kind="stable")
    ranked = h[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    nth = np.arange(len(h)) - np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    out = np.empty_like(h)
    out[order] = mixed(ranked + mixed(nth.astype(np.uint64) + np.uint64(1)))
    return out


def sketch(h: np.ndarray, count: int = SKETCHES, kept: int = KEPT) -> np.ndarray:
    """For each hash function (a random odd factor) the shingles with the ``kept`` least values, in text order, as one hash."""
    names, k = labelled(h), min(kept, len(h))
    places = np.tile(np.arange(k), (count, 1))
    step = max(1, 4_000_000 // len(h))  # functions at a time, so that a long text needs no more memory
    for j in range(0, count if len(h) > kept else 0, step):
        ranks = names[None] * SALTS[j : j + step, None]
        each = np.arange(len(ranks))
        for i in range(k):
            places[j : j + step, i] = least = ranks.argmin(axis=1)
            ranks[each, least] = np.iinfo(np.uint64).max
    places.sort(axis=1)
    out = np.arange(1, count + 1).astype(np.uint64)
    for i in range(k):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[places[:, i]])
    return out


def band(a: int, b: int, similarity: float) -> int:
    """The most shingles out of order or on one side only that texts of this similarity can have."""
    return a + b - 2 * int(np.ceil(similarity * (a + b) / (1 + similarity) - 1e-9))


def aligned(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """The insertions and deletions that turn a into b, if at most ``most``, by alignment in a band.

    Furthest-reaching points on the diagonals within the band, step by step; how far two stretches
    agree is found by bisection over prefix hashes modulo a prime, for all diagonals at once. A band
    of more than ``WIDE`` is aligned by the matches within it, if these are fewer than the points.
    """
    n, m = len(a), len(b)
    if most > WIDE:
        order = np.argsort(a, kind="stable")
        lo, hi = (np.searchsorted(a[order], b, side=x) for x in ("left", "right"))
        if (hi - lo).sum() < most * most // 8:
            d = n + m - 2 * chain(order, lo, hi)
            return d if d <= most else None
    ha, hb = PrimeHashes(mixed(a), max(n, m)), PrimeHashes(mixed(b), max(n, m))

    def agree(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        lo, hi = np.zeros(len(x), np.int64), np.minimum(n - x, m - y)
        while (lo < hi).any():
            mid = (lo + hi + 1) // 2
            same = ha.of(x, x + mid) == hb.of(y, y + mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    # reach[k + most + 1]: how far diagonal k has got; none yet is far below 0
    reach = np.full(2 * most + 3, -(n + m) - 9, np.int64)
    reach[most + 1] = agree(np.zeros(1, np.int64), np.zeros(1, np.int64))[0]
    for d in range(most + 1):
        if d:
            ks = np.arange(max(-d, -m + ((d - m) % 2 if d > m else 0)), min(d, n) + 1, 2)
            ks = ks[(ks >= -m) & (ks <= n)]
            at = ks + most + 1
            x = np.maximum(reach[at - 1] + 1, reach[at + 1])
            ok = (x >= 0) & (x <= n) & (x - ks >= 0) & (x - ks <= m)
            ks, at, x = ks[ok], at[ok], x[ok]
            reach[at] = x + agree(x, x - ks)
        if abs(n - m) <= most and reach[n - m + most + 1] >= n:
            return d
    return None


def chain(order: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> int:
    """Length of the longest common subsequence: of b's elements in turn, the places order[lo:hi] of their matches must rise."""
    ends: list[int] = []
    for i, j in zip(lo.tolist(), hi.tolist(), strict=True):
        for x in order[i:j][::-1].tolist():
            at = bisect_left(ends, x)
            if at == len(ends):
                ends.append(x)
            else:
                ends[at] = x
    return len(ends)


class Shingled:
    """A text's shingles in order, and their labelled names in order of hash."""

    def __init__(self, h: np.ndarray) -> None:
        self.h, self.names = h, labelled(h)
        self.order = np.argsort(self.names)
        self.ranked = self.names[self.order]


def near(a: Shingled, b: Shingled, similarity: float = SIMILARITY) -> bool:
    """Whether in-order shared shingles over all shingles come to ``similarity``.

    Too few shared shingles in any order rule it out. If the shared ones are in the same order on
    both sides they are the alignment; else it is worked out within the band.
    """
    most = band(len(a.h), len(b.h), similarity)
    if not len(a.h) or not len(b.h) or abs(len(a.h) - len(b.h)) > most:
        return False
    at = np.minimum(np.searchsorted(a.ranked, b.names), len(a.h) - 1)
    places = a.order[at[a.ranked[at] == b.names]]
    if len(a.h) + len(b.h) - 2 * len(places) > most:
        return False
    if (np.diff(places) > 0).all():
        return True
    return aligned(a.h, b.h, most) is not None


def similar(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    return near(Shingled(a), Shingled(b), similarity)


def sketched(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_of(text_col)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(5), text).alias("h2"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, out = [], []
            for t in b.column(3):
                h = shingles(t.as_py().encode())
                sizes.append(len(h))
                out.append(sketch(h).view(np.int64) if len(h) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(sizes, pa.int32()), pa.array(out, pa.list_(pa.int64()))], ["id", "h1", "h2", "n", "sketches"])

    return rows.mapInArrow(run, "id long, h1 long, h2 long, n int, sketches array<long>")


def matchable(texts: DataFrame) -> DataFrame:
    """(uid, groups): how many shingles of each group (by hash) of a text also occur in another of ``texts``, so that only these can be shared.

    Shingles are labelled by their occurrence, so of a repeated one no more counts than another text has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uid, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                h = labelled(shingles(t.as_py().encode()))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), uid))], ["h", "uid"])

    rows = texts.select("uid", "text").mapInArrow(run, "h long, uid long")
    shared = rows.groupBy("h").agg(F.count("*").alias("k")).filter("k > 1")
    found = rows.join(shared, "h").groupBy("uid", F.pmod("h", F.lit(GROUPS)).alias("g")).agg(F.count("*").alias("n"))
    return found.groupBy("uid").agg(F.array(*[F.coalesce(F.max(F.when(F.col("g") == g, F.col("n"))), F.lit(0)).cast("int") for g in range(GROUPS)]).alias("groups"))


def verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, Shingled] = {}
        held = 0
        for rows in batches:
            keep = []
            for a, b, x, y in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), rows.column(2), rows.column(3), strict=True):
                if held > REMEMBERED:
                    known.clear()
                    held = 0
                for uid, text in ((a, x), (b, y)):
                    if uid not in known:
                        known[uid] = Shingled(shingles(text.as_py().encode()))
                        held += len(known[uid].h)
                keep.append(near(known[a], known[b], similarity))
            yield rows.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    right = pairs.join(texts.select(F.col("uid").alias("b"), F.col("text").alias("text_b")), "b")
    both = right.join(texts.select(F.col("uid").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, label): the least node that each node of the edges (a, b) is connected to."""
    both = staged(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), f"{name}-labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("far")), "b").groupBy(F.col("a").alias("node")).agg(F.min("far").alias("far"))
        near = labels.join(seen, "node").select("node", F.col("label").alias("old"), F.least("label", "far").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("beyond"))
        new = staged(near.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("beyond", "label")).alias("label")), f"{name}-labels")
        if new.filter("old != label").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")


def near_dedup(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes of near copies over whole texts; one document of each class stays.

    Two texts are linked if an alignment of their sequences of five-word shingles shares at least
    ``similarity`` of all shingles: shared, in order, over the shingles of either. Equal texts are
    taken together first. A text has 24 order MinHash sketches, each of the three occurrence-labelled
    shingles with the least hashes, in text order, so that reordered texts part. Texts with an equal sketch
    are candidates.

    In each bucket of an equal sketch one pivot is held against all others. In buckets that still have several
    classes, members of all but the largest class are pivots in turn (about 2 of a bucket in a round, then 16, 128, until
    all have been), held against members of other classes. So every two texts of a bucket
    are compared unless they are known to be of one class, and a large
    bucket of near copies takes about as many comparisons as it has texts. After the first round, pairs are left out only
    where a bound proves them too unlike: shingles that no other text of an open bucket has can't be shared, and of each of 16 groups
    of shingles (by hash) no more than the text with fewer has.

    Texts of fewer than five words are one shingle; texts without words (also null) are near their equals only;
    repeated rows are copies. Null ids are smallest in the choice of what stays and return as null; ids are whole numbers. Of equal ids the text
    of the least hash stays. Other columns are not read; an empty table gives no rows.

    Returns id, text_hash, class_id (the least id of the class), class_size, kept (exactly one row of each class: the least id).
    """
    spark = docs.sparkSession
    rows = staged(sketched(docs, id_col, text_col), "near-sketches")
    texts = rows.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sketches").alias("sketches"))
    texts = staged(texts.withColumn("uid", F.monotonically_increasing_id()), "near-texts")
    release(spark)
    entries = texts.select("uid", "n", F.posexplode("sketches").alias("j", "s")).select("uid", "n", "j", F.xxhash64("j", "s").alias("key"))
    shared = entries.groupBy("key").agg(F.min("uid").alias("first"), F.max("uid").alias("last")).filter("first != last")
    members = staged(entries.join(shared.select("key", "first"), "key"), "near-buckets")
    release(spark)
    some = members.select("uid").distinct().join(texts.select("uid", "id", "h1", "h2"), "uid")
    text = text_of(text_col)
    found = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(5), text).alias("h2"), text.alias("text"))
    # repeated rows combine before they are moved
    bodies = staged(found.join(some, ["id", "h1", "h2"]).groupBy("uid").agg(F.first("text").alias("text")), "near-bodies")
    release(spark)

    close = F.least("n", "n_a") >= F.greatest("n", "n_a") * similarity - 1e-9

    def checked(pairs: DataFrame, before: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """The links among pairs that haven't been held against each other yet, and all pairs that have by now."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = staged(pairs.join(before, ["a", "b"], "left_anti") if before is not None else pairs, "near-pairs")
        links = staged(verified(pairs, bodies, similarity), "near-links")
        release(spark)
        return links, pairs if before is None else before.unionByName(pairs)

    pivots = members.filter("uid = first").select("key", F.col("uid").alias("a"), F.col("n").alias("n_a"))
    links, tested = checked(members.filter("uid != first").join(pivots, "key").filter(close).select("a", F.col("uid").alias("b")), None)
    labels = components(links, "near")
    pool, limit = members.select("key", "uid", "n", "j"), 2
    while True:
        # what is open: buckets of more than one class; pivots come from all but a bucket's largest class
        own = ["key", "uid", "n", *(["can", "groups", "before"] if "groups" in pool.columns else ["j"])]
        pool = pool.select(*own).join(labels.select(F.col("node").alias("uid"), "label"), "uid", "left").withColumn("label", F.coalesce("label", "uid"))
        classes = pool.groupBy("key", "label").agg(F.count("*").alias("k")).groupBy("key").agg(F.sum("k").alias("size"), F.max(F.struct("k", "label")).alias("top"), F.count("*").alias("classes"))
        open_ = classes.filter("classes > 1").select("key", F.col("top.label").alias("major"), (F.col("size") - F.col("top.k")).alias("minor"))
        pool = staged(pool.join(open_, "key"), "near-open")
        if "groups" not in pool.columns:
            able = matchable(bodies.join(pool.select("uid").distinct(), "uid"))
            # texts that can't be near any other leave; ``before``: a text's sketches before that of the bucket
            pool = pool.join(able.withColumn("can", F.aggregate("groups", F.lit(0), lambda x, y: x + y)), "uid").filter(F.col("can") >= similarity * F.col("n") - 1e-6)
            pool = staged(pool.join(texts.select("uid", "sketches"), "uid").withColumn("before", F.slice("sketches", F.lit(1), F.col("j"))).drop("sketches", "j"), "near-open")
        most = pool.agg(F.max("minor")).first()[0]
        if most is None:
            break
        some = fraction(F.lit(3), F.col("uid")) < F.lit(float(limit)) / F.col("minor")
        pivots = pool.filter((F.col("label") != F.col("major")) & some).select("key", *[F.col(c).alias(f"{c}_a") for c in ("n", "can", "groups", "before", "label")], F.col("uid").alias("a"))
        # what both can share at most: in each group of shingles as many as the one with fewer has
        enough = (F.col("n") + F.col("n_a")) * (similarity / (1 + similarity)) - 1e-6
        likely = close & (F.least("can", "can_a") >= enough)
        shared = sum(F.least(F.col("groups")[g], F.col("groups_a")[g]) for g in range(GROUPS))
        # a pair that shares several buckets comes up in the first of them alone
        likely = likely & ~F.arrays_overlap("before", "before_a") & (shared >= enough)
        pairs = pool.join(pivots, "key").filter((F.col("label") != F.col("label_a")) & likely).select("a", F.col("uid").alias("b"))
        links, tested = checked(pairs, tested)
        if not links.isEmpty():
            left, right = (labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}")) for c in "ab")
            merged = links.join(left, "a", "left").join(right, "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
            roots = components(merged.filter("a != b"), "near").withColumnsRenamed({"node": "root", "label": "to"})
            nodes = labels.unionByName(links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(labels, "node", "left_anti").select("node", F.col("node").alias("label")))
            labels = staged(nodes.join(roots, F.col("label") == F.col("root"), "left").select("node", F.coalesce("to", "label").alias("label")), "near-labels")
        if most <= limit:  # every minority member was a pivot
            break
        limit *= 8
    labels = texts.join(labels, F.col("uid") == F.col("node"), "left").select("h1", "h2", "id", "copies", F.coalesce("label", "uid").alias("label"))
    classes = labels.groupBy("label").agg(F.min("id").alias("class_id"), F.sum("copies").alias("class_size"), F.min(F.struct("id", "h1", "h2")).alias("stay"))
    named = staged(labels.select("h1", "h2", "label").join(classes, "label"), "near-classes")
    twin = F.row_number().over(W.partitionBy("id", "h1", "h2").orderBy("id"))
    out = rows.select("id", "h1", "h2").withColumn("twin", twin).join(named, ["h1", "h2"])
    real = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return out.select(real("id").alias(id_col), F.col("h1").alias("text_hash"), real("class_id").alias("class_id"), "class_size", ((F.struct("id", "h1", "h2") == F.col("stay")) & (F.col("twin") == 1)).alias("kept"))


def op3_minhash(spark, sf_dir):
    """All documents with their class of near copies; see ``near_dedup``."""
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_hash")
