"""Windows of units (bytes or words) that start more than once in a corpus.

Shared by the two substring operators. A window is ``length`` consecutive units of one text.

Every window holds ``width`` grams of ``gram`` units (length = gram + width - 1); the one with the
least hash, leftmost of equals, is its anchor. Equal windows have equal anchors at equal distances,
so windows need comparing only under anchors whose gram occurs more than once. An anchor stands for
a run of windows, those at distances ``low`` to ``high`` before it, and its context is all the
units that those windows cover. Anchors with the same context have the same windows, so one of
them, with a count, stands for all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import discard, release, staged, text_of

_rng = np.random.default_rng(20240229)
BYTE_VALUES = _rng.integers(0, 2**64, (2, 256), np.uint64)
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
INVERSES = tuple(pow(b, -1, 2**64) for b in BASES)
#: Rows that a task hands on at a time.
FLUSH = 200_000
NULL_ID = -(2**63)
#: A context's number and the distance of a window from its anchor (below this) are kept as one number.
CODES = 256
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.ones(max(1 << 16, 1 << int(n).bit_length()), np.uint64)
        have[1:] = np.uint64(base)
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


class Hashes:
    """Hashes of any stretch of a sequence of units, by a polynomial over its prefix sums."""

    def __init__(self, values: np.ndarray, which: int) -> None:
        self.which = which
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * powers(BASES[which], len(values)), dtype=np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        inverse = powers(INVERSES[self.which], len(self.sums))
        return mixed((self.sums[end] - self.sums[start]) * inverse[start] + (end - start).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))


PRIME = np.uint64((1 << 61) - 1)


def reduced(x: np.ndarray) -> np.ndarray:
    """x modulo 2**61 - 1."""
    x = (x & PRIME) + (x >> np.uint64(61))
    return np.where(x >= PRIME, x - PRIME, x)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2**61 - 1, from halves of 31 and 30 bits."""
    low, k30, k31 = np.uint64((1 << 31) - 1), np.uint64(30), np.uint64(31)
    a1, a0, b1, b0 = a >> k31, a & low, b >> k31, b & low
    mid = a1 * b0 + a0 * b1
    return reduced(a1 * b1 * np.uint64(2) + (mid >> k30) + ((mid & np.uint64((1 << 30) - 1)) << k31) + a0 * b0)


class PrimeHashes:
    """As Hashes, modulo the prime 2**61 - 1, under which no family of unequal texts is known to agree."""

    BASE = 0x1B0B5A3F2C9D7E11 % ((1 << 61) - 1)

    def __init__(self, values: np.ndarray, upto: int) -> None:
        """``upto``: the length of the longest text whose names are to be compared."""
        n = upto + 1
        have = np.ones(1, np.uint64)
        while len(have) < n:
            have = np.concatenate([have, product(have, np.uint64(pow(self.BASE, len(have), (1 << 61) - 1)))])
        self.powers = have[:n]
        terms = product(reduced(values), self.powers[: len(values)])
        half = np.uint64(32)
        low, high = (np.cumsum(x, dtype=np.uint64) for x in (terms & np.uint64(0xFFFFFFFF), terms >> half))
        self.sums = np.concatenate([np.zeros(1, np.uint64), reduced(product(reduced(high), np.uint64(1 << 32)) + reduced(low))])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A name of the stretch, as if it stood at place ``upto``, so that names of all texts up to that length compare."""
        return product(reduced(self.sums[end] + PRIME - self.sums[start]), self.powers[-1 - start])


#: Bytes of a word from which its hash is taken by a cryptographic function.
LONG_WORD = 200


class Units:
    """A text as units with hashes; ``bounds``: where each unit starts and ends among the bytes."""

    def __init__(self, data: bytes, words: bool, families: int = 2) -> None:
        self.data = np.frombuffer(data, np.uint8)
        if words:
            edge = np.diff(np.concatenate([[1], SPACE[self.data].view(np.int8), [1]]))
            self.starts, self.ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
            names = [Hashes(BYTE_VALUES[k][self.data], k).of(self.starts, self.ends) for k in range(families)]
            # polynomials modulo 2**64 agree on some pairs of words of 1024 bytes and more
            for i in np.flatnonzero(self.ends - self.starts > LONG_WORD).tolist():
                digest = hashlib.blake2b(data[self.starts[i] : self.ends[i]], digest_size=16).digest()
                for k, name in enumerate(names):
                    name[i] = int.from_bytes(digest[8 * k : 8 * k + 8], "little")
            self.hashes = [Hashes(name, k) for k, name in enumerate(names)]
            self.n = len(self.starts)
        else:
            self.hashes = [Hashes(BYTE_VALUES[k][self.data], k) for k in (0, 1)]
            self.n = len(data)


def least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    n = len(h) - width + 1
    blocks = np.concatenate([h, np.full(-len(h) % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchors_of(u: Units, gram: int, width: int) -> tuple[np.ndarray, ...]:
    """(position, low, high, hash of the gram, hash of the context) of each anchor of a text."""
    length = gram + width - 1
    if u.n < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    at = np.arange(u.n - gram + 1)
    grams = u.hashes[0].of(at, at + gram)
    low_bits = np.uint64((1 << int(u.n).bit_length()) - 1)
    first = least((grams & ~low_bits) | at.astype(np.uint64), width)
    change = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
    pos = (first[change] & low_bits).astype(np.int64)
    high = pos - change
    low = pos - np.concatenate([change[1:], [len(first)]]) + 1
    context = u.hashes[1].of(pos - high, pos - low + length) ^ mixed((low * 65536 + high + 1).astype(np.uint64))
    return pos, low, high, grams[pos].view(np.int64), context.view(np.int64)


def blocks_of(u: Units, length: int, width: int, size: int, cid: np.ndarray, cls: np.ndarray, pos: np.ndarray, low: np.ndarray, high: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows cut at multiples of ``size``: (code of context and first window, n, class key, inner hash, last window, outer hash).

    ``inner`` is what all windows of the whole block have in common, ``outer`` all that the windows
    of the run within it cover.
    """
    first, last = low // size, high // size
    count = last - first + 1
    own = np.repeat(np.arange(len(pos)), count)
    block = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count) + first[own]
    a, b = block * size, np.minimum(block * size + size, width) - 1
    lo, hi = np.maximum(a, low[own]), np.minimum(b, high[own])
    p = pos[own]
    key = mixed(cls[own].view(np.uint64) ^ mixed((block + 1).astype(np.uint64)))
    inner = u.hashes[1].of(p - a, p + length - b)
    outer = u.hashes[1].of(p - hi, p + length - lo) ^ mixed((lo * 65536 + hi + 1).astype(np.uint64))
    return cid[own] * CODES + lo, n[own], key.view(np.int64), inner.view(np.int64), hi, outer.view(np.int64)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows as (id, th, text): the identifier, null as the least long, and a hash of the text, which tell rows apart as far as they differ."""
    text = text_of(text_col)
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))


def joined_words(data: bytes) -> bytes:
    return b" ".join(data.split())


def scan(texts: DataFrame, words: bool, gram: int, width: int) -> DataFrame:
    """Rows of two kinds: a summary of each text (uid, id, th, its units in n, sha of the text with nothing removed), and its anchors (uid, pos, span, cls, ctx)."""
    names = ["uid", "pos", "span", "cls", "ctx", "id", "th", "n", "sha"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: list[list] = [[] for _ in names[:5]]
        rows = 0
        uid = TaskContext.get().partitionId() << 32

        def out() -> pa.RecordBatch:
            cols = [np.concatenate(h) for h in held]
            for h in held:
                h.clear()
            return pa.RecordBatch.from_arrays([*[pa.array(c, k) for c, k in zip(cols, kinds, strict=False)], *[pa.nulls(len(cols[0]), k) for k in kinds[5:]]], names)

        for b in batches:
            uids, sizes, shas = [], [], []
            for text in b.column(2):
                data = text.as_py().encode()
                u = Units(data, words)
                uid += 1
                uids.append(uid)
                sizes.append(u.n)
                shas.append(hashlib.sha256(joined_words(data) if words else data).hexdigest())
                pos, low, high, cls, ctx = anchors_of(u, gram, width)
                if len(pos):
                    for h, v in zip(held, [np.full(len(pos), uid), pos, low * CODES + high, cls, ctx], strict=True):
                        h.append(v)
                    rows += len(pos)
                    if rows > FLUSH:
                        yield out()
                        rows = 0
            yield pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), *[pa.nulls(b.num_rows, k) for k in kinds[1:5]], b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(shas, pa.string())], names)
        if rows:
            yield out()

    return texts.mapInArrow(run, "uid long, pos int, span int, cls long, ctx long, id long, th long, n long, sha string")


def digests(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A cryptographic digest of 64 bits of each stretch of bytes."""
    found = b"".join(hashlib.blake2b(data[i:j], digest_size=8).digest() for i, j in zip(start.tolist(), end.tolist(), strict=True))
    return np.frombuffer(found, np.int64)


def run_columns(runs: pa.ListScalar) -> list[np.ndarray]:
    """cid, cls, pos, low, high, n of a text's runs."""
    return [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in runs.values.flatten()]


def level(held: DataFrame, words: bool, length: int, width: int, size: int) -> DataFrame:
    """The blocks of ``size`` of the runs in ``runs`` (cid, cls, pos, low, high, n) of each text (uid, text, runs)."""
    names = ["code", "n", "key", "inner", "hi", "outer"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, runs in zip(b.column(1), b.column(2), strict=True):
                cid, cls, pos, low, high, n = run_columns(runs)
                found = blocks_of(Units(text.as_py().encode(), words), length, width, size, cid, cls, pos, low, high, n)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(found, kinds, strict=True)], names)

    return held.mapInArrow(run, "code long, n long, key long, inner long, hi int, outer long")


def decide(rows: DataFrame) -> DataFrame:
    """Blocks whose common part is not unique, with the sum of their counts and whether all of them have the same windows (``alike``).

    Counts are aggregated before they are shuffled and are joined back, so a window shared by
    many contexts is split by the skew join.
    """
    by = ["key", "inner"]
    alike = F.min("outer") == F.max("outer")
    stats = rows.groupBy(*by).agg(F.sum("n").alias("total"), alike.alias("alike")).filter("total > 1")
    return rows.drop("n", "outer").join(stats, by).drop(*by).withColumn("cid", F.shiftright("code", 8)).withColumn("lo", (F.col("code") % CODES).cast("int"))


def repeated_runs(docs: DataFrame, words: bool, gram: int, width: int, sizes: tuple[int, ...], name: str, id_col: str, text_col: str, last: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Per text: a summary, and for texts with repeats the text and its runs of repeated windows.

    Anchors whose gram is unique drop out first. For each of ``sizes`` runs are cut
    into shorter blocks, whose common part is longer. A block whose
    common part is unique drops out, and one whose windows are the same wherever they occur is done.
    ``last`` gets the runs left open, by text (uid, text, runs of cid, cls, pos, low, high, n), and returns the
    repeated windows among them as runs (cid, lo, hi). A run stands for ``n`` places with the same units.
    """
    spark = docs.sparkSession
    length = gram + width - 1
    texts = keyed(docs, id_col, text_col)
    scanned = staged(scan(texts, words, gram, width), f"{name}-anchors")
    summary = staged(scanned.filter("sha is not null").select("uid", "id", "th", "n", "sha"), f"{name}-summary")
    anchors = scanned.filter("sha is null").select("uid", "pos", "span", "cls", "ctx")
    common = anchors.groupBy("cls").agg(F.count("*").alias("k")).filter("k > 1").select("cls")
    repeated = staged(anchors.join(common, "cls", "left_semi"), f"{name}-repeated")
    discard(scanned)
    release(spark)

    by = ["cls", "ctx", "span"]
    contexts = repeated.groupBy(*by).agg(F.count("*").alias("n"), F.min(F.struct("uid", "pos")).alias("at"))
    kinds = contexts.groupBy("cls").agg(F.count("*").alias("kinds"))
    contexts = contexts.join(kinds, "cls").withColumn("cid", F.monotonically_increasing_id())
    contexts = staged(contexts.withColumn("low", F.shiftright("span", 8)).withColumn("high", F.col("span") % CODES), f"{name}-contexts")
    hits = repeated.join(contexts.select(*by, "cid"), by).groupBy("uid").agg(F.collect_list(F.struct("pos", "cid")).alias("hits"))
    run = F.struct("cid", "cls", "at.pos", "low", "high", "n").alias("run")
    runs = contexts.filter("kinds > 1").select(F.col("at.uid").alias("uid"), run).groupBy("uid").agg(F.collect_list("run").alias("runs"))
    wanted = hits.join(runs, "uid", "left").join(summary.select("uid", "id", "th"), "uid")
    if not summary.groupBy("id", "th").count().filter("count > 1").isEmpty():
        texts = texts.groupBy("id", "th").agg(F.first("text").alias("text"))  # repeated rows combine before they are moved
    held = staged(texts.join(wanted, ["id", "th"]).select("uid", "text", "hits", "runs"), f"{name}-texts")
    discard(repeated)
    release(spark)

    done = contexts.filter("kinds = 1").select("cid", F.col("low").alias("lo"), F.col("high").alias("hi"))
    at = held.filter("runs is not null").select("uid", "text", "runs")
    for size in sizes:
        blocks = staged(decide(level(at, words, length, width, size)), f"{name}-blocks")
        done = done.unionByName(blocks.filter("alike").select("cid", "lo", "hi"))
        more = blocks.filter("not alike").select("cid", "lo", "hi").join(contexts.select("cid", "cls", "n", "at"), "cid")
        more = more.select(F.col("at.uid").alias("uid"), F.struct("cid", "cls", "at.pos", F.col("lo").alias("low"), F.col("hi").alias("high"), "n").alias("run"))
        at = held.select("uid", "text").join(more.groupBy("uid").agg(F.collect_list("run").alias("runs")), "uid").select("uid", "text", "runs")
    done = done.unionByName(last(at))
    spans = staged(done.groupBy("cid").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), f"{name}-spans")
    release(spark)
    found = held.select("uid", F.explode("hits").alias("hit")).select("uid", "hit.pos", "hit.cid").join(spans, "cid")
    found = found.select("uid", "pos", F.explode("spans").alias("s")).groupBy("uid").agg(F.collect_list(F.struct((F.col("pos") - F.col("s.hi")).alias("first"), (F.col("pos") - F.col("s.lo")).alias("last"))).alias("starts"))
    return summary, held.select("uid", "text").join(found, "uid")


def covered(n: int, first: np.ndarray, last: np.ndarray, length: int) -> np.ndarray:
    """Which of n units are in a window that starts in one of the ranges first .. last."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, last + length, -1)
    return np.cumsum(edge)[:n] > 0


def removed(hit: DataFrame, words: bool, length: int) -> DataFrame:
    """Per text with repeats: n_removed, n_spans (maximal runs of removed units), kept_sha256."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for uid, text, starts in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                data = text.as_py().encode()
                first, last = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in starts.values.flatten())
                if words:
                    parts = data.split()
                    gone = covered(len(parts), first, last, length)
                    kept = b" ".join(w for w, g in zip(parts, gone, strict=True) if not g)
                else:
                    gone = covered(len(data), first, last, length)
                    kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1))
                out.append((uid, int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds], ["uid", "n_removed", "n_spans", "kept"])

    return hit.mapInArrow(run, "uid long, n_removed long, n_spans long, kept string")


def removal(docs: DataFrame, words: bool, gram: int, width: int, sizes: tuple[int, ...], name: str, id_col: str, text_col: str, last: Callable[[DataFrame], DataFrame]) -> DataFrame:
    summary, hit = repeated_runs(docs, words, gram, width, sizes, name, id_col, text_col, last)
    gone = removed(hit, words, gram + width - 1)
    own = F.when(F.col("id") != NULL_ID, F.col("id"))
    return summary.join(gone, "uid", "left").select(
        own.alias(id_col), F.col("n").alias("n_units"), F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept", "sha").alias("kept_sha256")
    )
