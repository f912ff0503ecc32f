"""Quality by positive-unlabelled learning: trusted good documents against unlabelled web text."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import fraction, staged, text_of

#: Documents to learn from: trusted positives, and unlabelled ones.
POSITIVES, UNLABELLED = 20_000, 40_000
#: Knots of a measure, as shares of the rows below them: a weight for each range between them.
KNOTS = (0, 0.05, 0.15, 0.5, 0.85, 0.95, 1)
#: Groups of characters that measures count.
GROUPS = ("upper", "lower", "other letter", "digit", "space", "line", "stop", "shout", "bracket", "symbol", "other")
#: Words before a word among which a repetition counts as near.
NEAR = 6
#: Code points whose group is looked up; those above count as other letters.
KNOWN = 0x3000
MEASURES = [f"share of {g}" for g in GROUPS] + [
    "words", "lines", "word length", "spread of word length", "longest word", "different words", "commonest word", "next word equal", "near word equal", "words without letters",
    "words all upper", "words with symbols", "lines twice", "line length", "lines that end a sentence", "different pairs",
]


def group_of(c: str) -> int:
    kind = unicodedata.category(c)
    if c in "\n\r\x0b\x0c":
        name = "line"
    elif c.isspace():
        name = "space"
    elif c in ".,;:":
        name = "stop"
    elif c in "!?":
        name = "shout"
    elif kind in ("Ps", "Pe", "Pi", "Pf"):
        name = "bracket"
    elif c < "\x80" and not c.isalnum():
        name = "symbol"
    else:
        name = {"Lu": "upper", "Ll": "lower", "Nd": "digit"}.get(kind, "other letter" if kind[0] in "LM" else "other")
    return GROUPS.index(name)


def groups() -> np.ndarray:
    return np.array([group_of(chr(i)) for i in range(KNOWN)] + [GROUPS.index("other letter")], np.uint8)


def measured(text: str, table: np.ndarray) -> list[float]:
    """The measures of one whole text; shares of nothing are 0."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = table[np.minimum(points, KNOWN)]
    n = max(1, len(text))
    count = np.bincount(kinds, minlength=len(GROUPS))
    words = text.split()
    if not words:
        return [*(count / n), *[0.0] * (len(MEASURES) - len(GROUPS))]
    size = np.fromiter(map(len, words), np.int64, len(words))
    plain = [w.strip(".,;:!?").lower() for w in words]
    seen: dict[str, int] = {}
    number = np.fromiter((seen.setdefault(w, len(seen)) for w in plain), np.int64, len(words))
    times = np.bincount(number)
    near = np.zeros(len(words), bool)
    for k in range(1, min(NEAR, len(words) - 1) + 1):
        near[k:] |= number[k:] == number[:-k]
    pairs = number[:-1] * len(seen) + number[1:]
    lines = [s for s in text.splitlines() if s.strip()]
    # what of a word's characters is letters, upper case or symbols, by sums over its stretch of the text
    inside = (kinds != GROUPS.index("space")) & (kinds != GROUPS.index("line"))
    starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    of = lambda *names: np.add.reduceat(np.isin(kinds, [GROUPS.index(x) for x in names]).astype(np.int32), starts) if len(starts) else np.zeros(1)
    letters, upper, odd = of("upper", "lower", "other letter"), of("upper"), of("symbol", "other", "bracket")
    return [
        *(count / n), np.log1p(len(words)), np.log1p(len(lines)), size.mean(), size.std(), np.log1p(size.max()), np.log1p(len(seen)) / np.log1p(len(words)),
        times.max() / len(words), float((number[1:] == number[:-1]).mean()) if len(words) > 1 else 0.0, near.mean(), (letters == 0).mean(), ((letters > 1) & (upper == letters)).mean(),
        (odd > 0).mean(), 1 - len(set(lines)) / max(1, len(lines)), np.log1p(n / max(1, len(lines))), sum(s.rstrip()[-1:] in ".!?:" for s in lines) / max(1, len(lines)),
        len(np.unique(pairs)) / max(1, len(pairs)),
    ]


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x): the measures of every whole text; a null text is empty. Reads these two columns only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = groups()
        for b in batches:
            x = [measured(t.as_py(), table) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], ["id", "x"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_of(f"`{text_col}`").alias("text")).mapInArrow(run, "id long, x array<double>")


def expanded(x: np.ndarray, knots: np.ndarray) -> np.ndarray:
    """Each measure as the range between knots that it falls into, with linear passage from knot to knot."""
    out = []
    for j, k in enumerate(knots):
        k = np.unique(k)
        out += [np.clip((x[:, j] - a) / (b - a), 0, 1) for a, b in pairwise(k)] or [np.zeros(len(x))]
    return np.stack(out, 1).astype(np.float32)


def descend(xp: np.ndarray, xu: np.ndarray, prior: float, steps: int, l2: float) -> tuple[np.ndarray, float]:
    """Minimise the non-negative unbiased risk prior R+(p) + max(0, R-(u) - prior R-(p)) of a linear score under logistic loss.

    Where the second part, the estimated risk on negatives, falls below zero, the score has learned the
    unlabelled rows by heart: the step then goes up that part instead. Full-batch Adam steps.
    """
    w, bias = np.zeros(xp.shape[1]), 0.0
    mean, var = np.zeros(xp.shape[1] + 1), np.zeros(xp.shape[1] + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    for step in range(1, steps + 1):
        zp, zu = xp @ w.astype(np.float32) + bias, xu @ w.astype(np.float32) + bias
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        up = sigmoid(zu) / len(zu), -prior * sigmoid(zp) / len(zp)  # slopes of the part on negatives
        if negative >= 0:
            gu, gp = up[0], up[1] - prior * sigmoid(-zp) / len(zp)
        else:
            gu, gp = -up[0], -up[1]
        grad = np.append(xp.T @ gp.astype(np.float32) + xu.T @ gu.astype(np.float32) + l2 * w, gp.sum() + gu.sum())
        mean, var = 0.9 * mean + 0.1 * grad, 0.999 * var + 0.001 * grad**2
        move = 0.05 * mean / (1 - 0.9**step) / (np.sqrt(var / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return w, float(bias)


def estimated_prior(sp: np.ndarray, su: np.ndarray, delta: float = 0.1) -> float:
    """The share of positives among the unlabelled, from scores of rows that the score wasn't fitted on.

    Above any threshold, unlabelled rows hold at least prior times the positives' share; the least ratio of the two shares,
    among thresholds where its confidence bound is least, is the estimate.
    """
    if not len(sp) or not len(su):
        return 0.5
    cuts = np.unique(np.quantile(sp, np.linspace(0, 0.98, 197)))
    qp = 1 - np.searchsorted(np.sort(sp), cuts, "left") / len(sp)
    qu = 1 - np.searchsorted(np.sort(su), cuts, "left") / len(su)
    slack = np.sqrt(np.log(4 / delta) / 2 / len(su)) + np.sqrt(np.log(4 / delta) / 2 / len(sp))
    best = np.argmin((qu + slack) / np.maximum(qp, 1e-9))
    return float(np.clip(qu[best] / max(qp[best], 1e-9), 0.02, 0.98))


def fit(xp: np.ndarray, xu: np.ndarray, steps: int = 800, l2: float = 2e-4) -> dict:
    """Knots, prior, weights and bias. For the prior, each half of the rows is scored by a first fit on the other half."""
    if not len(xp) or not len(xu):
        return {"prior": 0.5, "knots": [], "w": [], "bias": 0.0}
    knots = np.quantile(np.concatenate([xp, xu]), KNOTS, axis=0).T
    ep, eu = expanded(xp, knots), expanded(xu, knots)
    sp, su = np.zeros(len(ep)), np.zeros(len(eu))
    if min(len(ep), len(eu)) > 1:
        for half in (0, 1):
            w, bias = descend(ep[half::2], eu[half::2], 0.5, steps // 2, l2)
            sp[1 - half :: 2], su[1 - half :: 2] = ep[1 - half :: 2] @ w + bias, eu[1 - half :: 2] @ w + bias
    prior = estimated_prior(sp, su)
    w, bias = descend(ep, eu, prior, steps, l2)
    return {"prior": prior, "knots": knots.tolist(), "w": w.tolist(), "bias": bias}


def first_by_hash(rows: DataFrame, seed: int, most: int) -> DataFrame:
    """The ``most`` rows of the smallest hash of ``id``. A bound on the hash leaves about twice as many to sort, however many rows there are."""
    share = 2 * most / max(1, rows.count())
    near = rows.filter(fraction(F.lit(seed), F.col("id")) < share) if share < 1 else rows
    return near.orderBy(fraction(F.lit(seed), F.col("id")), "id", "x").limit(most)


def train(found: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> dict:
    """Learn from ``found`` (id, x): documents whose labels are all 1 as trusted positives, and other documents without their labels.

    Neither set has documents whose crc32(id as text) mod 5 is 0. At most ``positives`` and ``unlabelled`` rows are used, those with the
    smallest hash of the identifier; one task fits on their measures alone. Labels 0 are not used at all.

    Null labels and identifiers are left out; a document with both labels isn't trusted; of rows that share an
    identifier the one of the least measures is used. Without positives or without documents the score is 0.5 everywhere.
    """
    learns = lambda c: F.coalesce(F.crc32(F.col(c).cast("string").cast("binary")) % 5 != 0, F.lit(False))
    trusted = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").alias("y")).filter(learns("id") & F.col("y").isNotNull()).groupBy("id").agg(F.min("y").alias("y")).filter("y = 1")
    rows = found.filter(learns("id"))
    some = first_by_hash(rows.join(trusted, "id", "left_semi"), 11, positives).withColumn("kind", F.lit(1))
    web = first_by_hash(rows, 12, unlabelled).withColumn("kind", F.lit(0))
    sample = staged(some.unionByName(web).groupBy("kind", "id").agg(F.min("x").alias("x")), "quality-sample")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).flatten().to_numpy().reshape(-1, len(MEASURES))) for b in batches if b.num_rows]
        kind, x = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.zeros(0), np.zeros((0, len(MEASURES))))
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps(fit(x[kind == 1], x[kind == 0]))])], ["model"])

    model = sample.repartition(1).sortWithinPartitions(F.xxhash64(F.lit(13), "id"), "id", "kind").select("kind", "x").mapInArrow(run, "model string").first()
    return json.loads(model[0]) if model else fit(np.zeros((0, len(MEASURES))), np.zeros((0, len(MEASURES))))


def scored(found: DataFrame, model: dict) -> DataFrame:
    """Add ``score`` to (id, x): the probability of a good document under the model."""
    sent = found.sparkSession.sparkContext.broadcast(model)  # a number for each measure and knot

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            if m["w"] and b.num_rows:
                z = expanded(b.column(1).flatten().to_numpy().reshape(-1, len(MEASURES)), np.array(m["knots"])) @ np.array(m["w"]) + m["bias"]
            else:
                z = np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], ["id", "score"])

    return found.mapInArrow(run, "id long, score double")


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", least: float = 0.3, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> DataFrame:
    """Score every whole text: id, held_out, score, predicted, and ``prior``, the estimated share of good documents.

    Whole texts of any length are measured once; the measures are staged, learned from and scored. Labels, languages,
    sources and identifiers are never inputs of a score. Null texts are empty, and scored so; repeated rows and rows with
    a null identifier (never held out) are scored one by one; equal texts have equal scores, so ties don't matter; an empty table gives no rows;
    other columns are not read.
    """
    found = staged(measures(docs, id_col, text_col), "quality-measures")
    model = train(found, labels, id_col, label_col, positives, unlabelled)
    held = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return scored(found, model).select(F.col("id").alias(id_col), held.alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"), F.lit(model["prior"]).alias("prior"))


def op11_quality(spark, sf_dir):
    """All documents, learned from the labels of four fifths of the labelled ones."""
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
