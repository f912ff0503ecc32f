"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm.common import staged, text_of

WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[.!?\n]+")
#: Labelled documents to learn from, toxic and other; words and word beginnings that may get a weight.
TOXIC_SAMPLE, OTHER_SAMPLE, FEATURES = 4000, 8000, 4000
#: Characters of all texts to learn from.
SAMPLE_CHARS = 60_000_000
#: Features that a task counts before it hands its counts on.
FLUSH = 200_000
#: Lengths of the word beginnings, by which inflected forms share a weight.
STEMS = (4, 5, 6)


def features_of(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in STEMS if len(word) >= k)]


class Weights(dict):
    """The summed weight of a word's features, worked out once for each distinct word."""

    def __init__(self, model: dict[str, float], most: int = 200_000) -> None:
        super().__init__()
        self.model, self.most = model, most

    def __missing__(self, word: str) -> float:
        if len(self) > self.most:
            self.clear()
        get = self.model.get
        self[word] = total = sum(get(f, 0.0) for f in features_of(word))
        return total


def sentences(text: str) -> list[str]:
    """The sentences of a text in lower case; a text without any has one empty sentence."""
    return [s for s in SENTENCE.split(text.lower()) if s.strip()] or [""]


def split_features(text: str) -> list[set[str]]:
    """The features of each sentence of a text."""
    return [{f for w in set(WORD.findall(s)) for f in features_of(w)} for s in sentences(text)]


def fit_noisy_or(ids: np.ndarray, sizes: np.ndarray, owner: np.ndarray, plain: np.ndarray, labels: np.ndarray, weights: np.ndarray, features: int, steps: int = 400, l1: float = 2e-5) -> tuple[np.ndarray, float]:
    """Weights of features, and the bias, of a sentence model, from document labels.

    Sentences come as one sparse matrix: ``ids`` holds the features of one sentence after the other,
    ``sizes`` how many each has (at least one), ``owner`` its document; ``plain`` counts the sentences
    of a document without any feature. A sentence is toxic with probability sigmoid(bias + weights of
    its features); a document is if any of its sentences is: P = 1 - prod(1 - p). Full-batch gradient
    steps on the weighted log likelihood with soft thresholding, so features that tell nothing get no weight.
    """
    y, wt = labels.astype(float), weights / max(weights.sum(), 1e-300)
    w, bias = np.zeros(features), -6.0
    mean, var = np.zeros(features + 1), np.zeros(features + 1)
    row_at = np.cumsum(sizes, dtype=np.int64) - sizes
    by_feature = np.argsort(ids, kind="stable").astype(np.int32)
    sentence = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[by_feature]
    present, col_at = np.unique(ids[by_feature], return_index=True)
    del by_feature
    for step in range(1, steps + 1):
        z = bias + (np.add.reduceat(w[ids], row_at) if len(ids) else np.zeros(0))
        none = np.bincount(owner, np.logaddexp(0, z), len(y)) + plain * np.logaddexp(0, bias)
        any_ = np.maximum(-np.expm1(-none), 1e-12)
        pull = wt * (y / any_ - 1)
        slope = pull[owner] / (1 + np.exp(-z))
        grad = np.zeros(features + 1)
        if len(ids):
            grad[present] = np.add.reduceat(slope[sentence], col_at)
        grad[-1] = slope.sum() + (pull * plain).sum() / (1 + np.exp(-bias))
        mean, var = 0.9 * mean + 0.1 * grad, 0.999 * var + 0.001 * grad**2
        pace = 0.1 / (np.sqrt(var / (1 - 0.999**step)) + 1e-7)
        move = pace * mean / (1 - 0.9**step)
        w, bias = w + move[:-1], bias + move[-1]
        w = np.sign(w) * np.maximum(np.abs(w) - pace[:-1] * l1, 0)
    return w, float(bias)


def sampled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, toxic_sample: int, other_sample: int, most_chars: int) -> DataFrame:
    """The labelled documents to learn from: (id, text, y, wt)."""
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 != 0))
    known = known.groupBy(F.col(id_col).alias("l_id")).agg(F.max(label_col).cast("int").alias("y"))
    share = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    some = None
    for label, most in ((1, toxic_sample), (0, other_sample)):
        part = known.filter(F.col("y") == label).orderBy(F.xxhash64(F.lit(6), "l_id"), "l_id").limit(most)
        part = part.withColumn("wt", F.lit(share.get(label, 0) / max(1, min(most, share.get(label, 0)))))
        some = part if some is None else some.unionByName(part)
    text = text_of(text_col)
    found = docs.select(F.col(id_col).alias("id"), text.alias("text")).join(F.broadcast(some), F.col("id") == F.col("l_id"))
    # of rows with one identifier, the text of the least hash
    found = found.groupBy("id", "y", "wt").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("id", "y", "wt", "t.text")
    found = staged(found, "toxicity-labelled")
    order = W.orderBy(F.xxhash64(F.lit(7), "id"), "id")  # at most both samples' rows, without their texts
    sizes = found.select("id", F.char_length("text").cast("long").alias("chars"))
    some = sizes.withColumn("chars", F.sum("chars").over(order)).filter(F.col("chars") <= most_chars).select("id")
    return found.join(F.broadcast(some), "id", "left_semi").select("id", "text", "y", "wt")


def vocabulary_of(sample: DataFrame, features: int) -> list[str]:
    """The features that tell most: greatest log odds ratio of the labels over its standard error, from counts of documents."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), *[pa.array([v[k] for v in seen.values()], pa.int64()) for k in (0, 1)]], ["word", "n0", "n1"])

        for b in batches:
            for text, y in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                for f in set().union(*split_features(text.as_py())):
                    seen.setdefault(f, [0, 0])[y] += 1
                if len(seen) > FLUSH:
                    yield out()
                    seen.clear()
        yield out()

    n = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    counts = sample.select("text", "y").mapInArrow(counted, "word string, n0 long, n1 long").groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).filter("n0 + n1 >= 3")
    odds = lambda k: F.log((F.col(f"n{k}") + 0.5) / (F.lit(max(1, n.get(k, 0)) + 0.5) - F.col(f"n{k}")))
    tells = F.abs(odds(1) - odds(0)) / F.sqrt(1 / (F.col("n1") + 0.5) + 1 / (F.col("n0") + 0.5))
    return [r["word"] for r in counts.orderBy(F.desc(tells), "word").limit(features).select("word").collect()]


def encoded(sample: DataFrame, at: Broadcast) -> DataFrame:
    """Each document as arrays: features of its sentences, their number in each sentence that has any, sentences without."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = at.value
        for b in batches:
            ids, sizes, plain = [], [], []
            for text in b.column(1):
                each = [sorted(known[f] for f in s if f in known) for s in split_features(text.as_py())]
                full = [x for x in each if x]
                ids.append(np.fromiter((i for x in full for i in x), np.int32))
                sizes.append(np.fromiter(map(len, full), np.int32))
                plain.append(len(each) - len(full))
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(ids, ints), pa.array(sizes, ints), pa.array(plain, pa.int32())], ["id", "y", "wt", "ids", "sizes", "plain"])

    return sample.select("id", "text", "y", "wt").mapInArrow(run, f"id {sample.schema['id'].dataType.simpleString()}, y int, wt double, ids array<int>, sizes array<int>, plain int")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", toxic_sample: int = TOXIC_SAMPLE, other_sample: int = OTHER_SAMPLE, most_chars: int = SAMPLE_CHARS, features: int = FEATURES) -> dict[str, float]:
    """Learn the model from labelled rows whose crc32(id as text) mod 5 is not 0.

    At most ``toxic_sample`` and ``other_sample`` rows of each label are used, those with the
    smallest hash of the identifier, and of these as many, in another hash order, as come to
    ``most_chars`` characters; each stands for as many labelled rows as its share. Spark counts the features, keeps
    the ``features`` best and encodes the sentences as numbers; one task then fits on these numbers alone,
    whose size the three bounds limit.

    Rows with a null label or identifier, or without a document, are left out; a label that is given twice
    counts as 1 if any is; of rows that share an identifier one is used; null texts are empty. Without any labels the model is a small constant.
    """
    sample = staged(sampled(docs, labels, id_col, text_col, label_col, toxic_sample, other_sample, most_chars).repartition(max(8, docs.sparkSession.sparkContext.defaultParallelism * 2)), "toxicity-sample")
    words = vocabulary_of(sample, features)
    at = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(words)})  # ``features`` words at most

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [[c.to_numpy(zero_copy_only=False) for c in b.columns[1:3]] + [c.values.to_numpy() if c.type == pa.list_(pa.int32()) else c.to_numpy() for c in b.columns[3:]] + [c.value_lengths().to_numpy() for c in b.columns[4:5]] for b in batches if b.num_rows]
        if not rows:
            return
        y, wt, ids, sizes, plain, sentences_ = (np.concatenate(x) for x in zip(*rows, strict=True))
        owner = np.repeat(np.arange(len(y), dtype=np.int32), sentences_)
        w, bias = fit_noisy_or(ids, sizes, owner, plain, y, wt, len(words))
        told = np.flatnonzero(np.abs(w) > 1e-3)
        yield pa.RecordBatch.from_arrays([pa.array(["", *(words[i] for i in told)], pa.string()), pa.array(np.concatenate([[bias], w[told]]))], ["word", "weight"])

    numbers = staged(encoded(sample, at), "toxicity-numbers")
    model = numbers.repartition(1).sortWithinPartitions("id").mapInArrow(fit, "word string, weight double")
    return {r["word"]: r["weight"] for r in model.collect()} or {"": -6.0}


def score_text(text: str, weights: Weights) -> tuple[float, list[tuple[int, float]]]:
    """The score of a text, and (place, score) of each sentence of 0.5 or more."""
    bias, none, offending = weights.model[""], 0.0, []
    for k, s in enumerate(sentences(text)):
        z = bias + sum(map(weights.__getitem__, set(WORD.findall(s))))
        none += float(np.logaddexp(0, z)) if z > -30 else 0.0
        if z >= 0:
            offending.append((k, float(1 / (1 + np.exp(-z)))))
    return float(-np.expm1(-none)), offending


def score(docs: DataFrame, model: dict[str, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every whole text by noisy-or over its sentences: 1 - prod(1 - sigmoid(bias + weights)).

    Null texts are empty and have one empty sentence; labels and other columns are not read; repeated rows and
    rows with a null id (never held out) are scored one by one; an empty table gives none.

    Returns id, held_out, score, predicted, and ``offending``: (sentence, score) of sentences of 0.5 or more.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)  # FEATURES words at most
    kinds = pa.list_(pa.struct([("sentence", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(sent.value)
        base = float(np.logaddexp(0, weights.model[""]))
        for b in batches:
            scores, found = [], []
            for text in b.column(1).to_pylist():
                text = text or ""
                if not any(map(weights.__getitem__, WORD.findall(text.lower()))):  # all sentences score alike
                    n = sum(1 for s in SENTENCE.split(text) if s.strip()) or 1
                    scores.append(float(-np.expm1(-n * base)))
                    found.append([])
                else:
                    value, where = score_text(text, weights)
                    scores.append(value)
                    found.append([{"sentence": k, "score": v} for k, v in where])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array(found, kinds)], ["id", "score", "offending"])

    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, score double, offending array<struct<sentence:int,score:double>>")
    held = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return out.select(F.col("id").alias(id_col), held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "offending")


def without_toxic(docs: DataFrame, model: dict[str, float], text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are (also null and repeated ones), whose whole text scores below 0.5.

    A null text is empty. Columns keep their names, whatever these are; an empty table stays empty.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES words at most
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(sent.value)
        for b in batches:
            yield b.filter(pa.array([score_text(t.as_py() or "", weights)[0] < 0.5 for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op6_toxicity(spark, sf_dir):
    """All documents scored by a model of the labelled ones; see ``score`` and ``train``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
