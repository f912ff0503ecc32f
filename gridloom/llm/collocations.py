"""Phrases whose words occur together more than their parts suggest, mined from n-gram counts."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm.common import LOWER, UPPER, staged, text_of

#: Bytes of text whose n-grams are made and counted together, inside a task.
CHUNK = 2 << 20
#: Lower case for A-Z, a newline for whatever ends a piece, a space between words.
PLAIN = bytes.maketrans(UPPER.encode() + b".,;:!?\x0b\x0c\r\t", LOWER.encode() + b"\n" * 9 + b" ")
#: Bits of a filter of frequent phrases, and of a slice of it that one task makes. A full filter lets everything through.
BITS, SLICE = 1 << 26, 1 << 20
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def hashes(start: np.ndarray | int, *words: np.ndarray) -> np.ndarray:
    """A hash of each phrase from the checksums of its language and of its words, one array for each place."""
    h = np.zeros(len(words[0]), np.uint64) + np.asarray(start, np.uint64)
    for w in words:
        h = h * SPREAD + w
        h ^= h >> np.uint64(29)
    return h


def places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a phrase."""
    return (h % np.uint64(BITS)).astype(np.int64), ((h >> np.uint64(32)) * SPREAD % np.uint64(BITS)).astype(np.int64)


def passes(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    one, two = places(h)
    return (bits[one >> 3] >> (one & 7) & bits[two >> 3] >> (two & 7) & 1).astype(bool)


def grams(texts: list[bytes], n: int, seed: int, bits: np.ndarray | None) -> tuple[pa.Array, np.ndarray]:
    """The different n-grams of the texts and how often each occurs, never across pieces.

    ``bits`` is a filter of the phrases of n - 1 words that occur often enough; n-grams with another part are left out.
    """
    x = np.frombuffer(b"\n".join(texts).translate(PLAIN), np.uint8)
    inside = (x != 32) & (x != 10)
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    coded = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(x[inside])).dictionary_encode()
    words = phrases = coded.dictionary
    code = coded.indices.to_numpy().astype(np.int64)
    if n == 1:
        return words, np.bincount(code, minlength=len(words))
    piece = np.searchsorted(np.flatnonzero(x == 10), starts)
    at = np.flatnonzero(piece[: 1 - n] == piece[n - 1 :]) if len(piece) >= n else np.zeros(0, np.int64)
    if bits is not None:
        sums = np.fromiter((zlib.crc32(w) for w in words.cast(pa.binary()).to_pylist()), np.uint64, len(words))[code]
        ok = passes(bits, hashes(seed, *(sums[k : len(sums) + k - n + 2] for k in range(n - 1))))
        at = at[ok[at] & ok[at + 1]]
    last = code[at]
    for k in range(1, n):  # an n-gram is the number of its first words and that of its last
        coded = pa.array(last * len(words) + code[at + k], pa.int64()).dictionary_encode()
        key, last = coded.dictionary.to_numpy(), coded.indices.to_numpy().astype(np.int64)
        phrases = pc.binary_join_element_wise(phrases.take(pa.array(key // max(1, len(words)))), words.take(pa.array(key % max(1, len(words)))), " ")
    return phrases, np.bincount(last, minlength=len(phrases))


def gram_counts(docs: DataFrame, n: int, bits: np.ndarray | None = None, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, phrase, f) of all n-grams that ``bits`` lets through; with n = 1, the empty phrase counts all words of its language.

    Tasks make the n-grams of every whole text and add up equal ones of some megabytes of text; these rows are
    aggregated by hash, partly before the shuffle, so a very frequent word is one row a task.
    """
    sent = docs.sparkSession.sparkContext.broadcast(bits)  # BITS at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, text = b.column(0), b.column(1).cast(pa.binary())
            for one in pc.unique(lang):
                chunk, size, seed = [], 0, zlib.crc32(one.as_py().encode())
                own = pc.indices_nonzero(pc.equal(lang, one)).to_pylist()
                for i in [*own, None]:
                    if i is not None:
                        chunk.append(text[i].as_py())
                        size += len(chunk[-1])
                    if chunk and (i is None or size >= CHUNK):
                        phrases, f = grams(chunk, n, seed, sent.value)
                        if n == 1:
                            phrases, f = pa.concat_arrays([phrases, pa.array([""])]), np.append(f, f.sum())
                        yield pa.RecordBatch.from_arrays([pa.repeat(one, len(phrases)), phrases, pa.array(f, pa.int64())], ["lang", "phrase", "f"])
                        chunk, size = [], 0

    lang = F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und"))
    rows = docs.select(lang.alias("lang"), text_of(text_col).alias("text")).mapInArrow(run, "lang string, phrase string, f long")
    return rows.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def filter_of(phrases: DataFrame, n: int) -> np.ndarray:
    """The bits of phrases (lang, phrase) of n words: tasks name their bits, others put slices together, the driver gets ``BITS`` at most."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            starts = np.fromiter((zlib.crc32(x.encode()) for x in b.column(0).to_pylist()), np.uint64, b.num_rows)
            sums = np.fromiter((zlib.crc32(w.encode()) for x in b.column(1).to_pylist() for w in x.split(" ")), np.uint64).reshape(-1, n)
            place = np.unique(np.concatenate(places(hashes(starts, *sums.T))))
            yield pa.RecordBatch.from_arrays([pa.array(place // SLICE, pa.int32()), pa.array(place % SLICE, pa.int32())], ["slice", "place"])

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for b in batches:
            which, place = b.column(0).to_numpy(), b.column(1).to_numpy()
            for k in np.unique(which):
                own = made.setdefault(int(k), np.zeros(SLICE // 8, np.uint8))
                np.bitwise_or.at(own, place[which == k] >> 3, (1 << (place[which == k] & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array(made.keys(), pa.int32()), pa.array([v.tobytes() for v in made.values()], pa.binary())], ["slice", "bits"])

    slices = phrases.select("lang", "phrase").mapInArrow(named, "slice int, place int").repartition(BITS // SLICE, "slice").mapInArrow(put, "slice int, bits binary")
    out = np.zeros(BITS // 8, np.uint8)
    for r in slices.collect():  # a row a slice
        out[r["slice"] * SLICE // 8 : (r["slice"] + 1) * SLICE // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def frequent_grams(docs: DataFrame, max_n: int, least: int, text_col: str, lang_col: str) -> DataFrame:
    """(lang, phrase, f) of all phrases of up to ``max_n`` words that occur ``least`` times, and the empty ones with the word totals.

    Level by level: a phrase can't occur more often than its parts, so n-grams with a part that is known to occur less
    often aren't shuffled. What tells is a filter of bounded size that errs to one side only; counts come from the aggregation alone.
    """
    found = bits = None
    for n in range(1, max_n + 1):
        level = staged(gram_counts(docs, n, bits, text_col, lang_col).filter((F.col("f") >= least) | (F.col("phrase") == "")), f"collocations-{n}")
        found = level if found is None else found.unionByName(level)
        bits = filter_of(level.filter("phrase != ''"), n) if n < max_n else None
    return found


def collocations(docs: DataFrame, max_n: int = 3, least: int = 10, contained: int = 50, top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z) and split into pieces at ``[.,;:!?\\x0A-\\x0D]`` and those into words ``[^\\x20\\x09]+``.
    Candidates are phrases of 2 to ``max_n`` words that occur ``least`` times (a). Of the cuts into l and r (occurrences of
    the first words and of the rest) the one of the least floor(1000000 a a / (l r)) counts, of equal ones the first. A candidate goes if
    a one-word extension of it is a candidate and has ``contained`` percent of its occurrences or more; longer ones need no look,
    since occurrences never grow with the phrase. Products are decimals of 38 digits, exact for counts up to 10^16.

    Null texts are empty, a null language is ``und``; empty texts and tables add nothing (a language without candidates has no rows);
    texts of any length go through whole; repeated rows count as often as they are there; ties in score and a are ordered by the phrase's bytes; other columns are not read.
    """
    counted = frequent_grams(docs, max_n, least, text_col, lang_col)
    words = F.split("phrase", " ")
    found = counted.filter("phrase != ''").withColumn("w", words)
    join = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    candidates = found.filter(F.size("w") >= 2)
    # every cut of every candidate meets the counts of both its parts
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1))).select("lang", "phrase", F.col("f").alias("a"), "k", join(F.lit(1), F.col("k")).alias("first"), join(F.col("k") + 1, F.size("w")).alias("rest"))
    parts = found.filter(F.size("w") < max_n)
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    exact = lambda c: F.col(c).cast("decimal(16,0)")
    cuts = cuts.withColumn("aa", (exact("a") * exact("a")).cast("decimal(32,0)")).withColumn("lr", (exact("l") * exact("r")).cast("decimal(32,0)"))
    cuts = cuts.withColumn("score", F.expr("cast(aa * 1000000bd as decimal(38,0)) div lr"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    longer = candidates.filter(F.size("w") >= 3).select("lang", "f", F.explode(F.array(join(F.lit(1), F.size("w") - 1), join(F.lit(2), F.size("w")))).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    held = F.col("longer").cast("decimal(20,0)") * 100 >= F.col("a").cast("decimal(20,0)") * contained
    left = scored.join(longer.withColumnsRenamed({"lang": "x_lang", "phrase": "x_phrase"}), (F.col("lang") == F.col("x_lang")) & (F.col("phrase") == F.col("x_phrase")) & held, "left_anti")
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)  # each task's first rows go on only
    totals = counted.filter("phrase = ''").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


SQL = r"""
WITH pieces AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, (SELECT unnest([1, 2, 3]) AS k)) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM g WHERE k > 1 AND f >= 10),
cut AS (SELECT lang, k, phrase, a, array_to_string(w[1:j], ' ') AS x, array_to_string(w[j + 1:k], ' ') AS y, j FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
s AS (SELECT cut.lang, cut.k, cut.phrase, a, j, p.f AS l, q.f AS r, (1000000::HUGEINT * a::HUGEINT * a::HUGEINT) // (p.f::HUGEINT * q.f::HUGEINT) AS score FROM cut JOIN g p ON p.lang = cut.lang AND p.phrase = x JOIN g q ON q.lang = cut.lang AND q.phrase = y),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS nth FROM s),
inside AS (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM c WHERE k = 3),
kept AS (SELECT * FROM b WHERE nth = 1 AND NOT EXISTS (SELECT 1 FROM inside WHERE inside.lang = b.lang AND inside.phrase = b.phrase AND 100 * inside.a >= 50 * b.a))
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept) JOIN n USING (lang) WHERE rank <= 2000
"""


def op13_collocations(spark, sf_dir):
    """Phrases of 2 and 3 words of all documents, at least 10 times, the first 2000 of each language."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))
