"""Product codes of vectors: codebooks by integer rounds, nearest entries by ball trees."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import staged

#: Integer components beyond this would let squared distances pass 64 bits.
MOST = 1 << 28
#: Entries of a leaf.
LEAF = 8
#: Labels with more than one row in so many are joined by a broadcast (there are fewer than that), the rest by a shuffle.
HOT = 1000
#: What rounding can take from a computed distance, as a part of it, with a wide margin.
SLACK = 1e-9


class BallTree:
    """A ball tree over the entries of one codebook, searched by many points together.

    A node's ball covers its entries: the radius is rounded up. A ball is left out only where its lower
    bound, rounded down, is above the distance already found; equal bounds are visited, since an entry of a lower index may
    be as near. Whatever decides is an integer distance.
    """

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        self.root = self.built(np.arange(len(entries)))

    def built(self, at: np.ndarray) -> tuple:
        """(centre, radius, indices, children) of the entries at these indices."""
        own = self.entries[at].astype(float)
        centre = own.mean(axis=0)
        away = np.sqrt(((own - centre) ** 2).sum(axis=1))
        radius = float(away.max()) * (1 + SLACK) + SLACK
        if len(at) <= LEAF or not away.any():
            return centre, radius, at, ()
        one = own[away.argmax()]
        from_one = ((own - one) ** 2).sum(axis=1)
        two = own[from_one.argmax()]
        side = from_one <= ((own - two) ** 2).sum(axis=1)
        if side.all():
            return centre, radius, at, ()
        return centre, radius, at, (self.built(at[side]), self.built(at[~side]))

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry (the lowest of equals) and squared distance of each point."""
        index, best = np.full(len(points), len(self.entries)), np.full(len(points), np.iinfo(np.int64).max)
        real = points.astype(float)
        away = lambda node, rows: np.sqrt(((real[rows] - node[0]) ** 2).sum(axis=1))

        def verify(node: tuple, rows: np.ndarray) -> None:
            for e in node[2]:
                gap = points[rows] - self.entries[e]
                d = (gap * gap).sum(axis=1)
                better = (d < best[rows]) | ((d == best[rows]) & (e < index[rows]))
                best[rows[better]], index[rows[better]] = d[better], e

        def descend(node: tuple, rows: np.ndarray) -> None:
            if not node[3]:
                verify(node, rows)
                return
            left, right = node[3]
            near = away(left, rows) <= away(right, rows)
            for child, own in ((left, rows[near]), (right, rows[~near])):
                if len(own):
                    descend(child, own)

        def bound(node: tuple, rows: np.ndarray) -> None:
            least = np.maximum(away(node, rows) * (1 - SLACK) - node[1], 0)
            rows = rows[least * least * (1 - SLACK) <= best[rows]]
            if len(rows):
                for child in node[3]:
                    bound(child, rows)
                if not node[3]:
                    verify(node, rows)

        if len(points):
            descend(self.root, np.arange(len(points)))  # a first answer for each point, so that bounds cut early
            bound(self.root, np.arange(len(points)))
        return index, best


def integers(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, v): rows with whole finite vectors, floor(1024 x) of each component."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    whole = F.coalesce(F.col(f"`{vector_col}`").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    return vectors.filter(whole).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").alias("label"), F.transform(v, lambda x: F.when(F.abs(x) < MOST / 1024, F.floor(x * 1024)).otherwise(F.raise_error(F.lit(f"a component is beyond {MOST // 1024}")).cast("long")).cast("int")).alias("v"))


def matrix(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of ``dims`` components, and those components."""
    sizes = np.diff(column.offsets.to_numpy())
    fit = sizes == dims
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return fit, flat[np.repeat(fit, sizes)].reshape(-1, dims).astype(np.int64)


def partial_sums(rows: DataFrame, books: list[np.ndarray], dims: int) -> DataFrame:
    """(part, entry, place, n, s): rows at each entry and sums of their components; added up inside a task first."""
    sent = rows.sparkSession.sparkContext.broadcast(books)  # parts x entries x components: at most ``entries`` vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [BallTree(b) for b in sent.value]
        width = dims // len(trees)
        n = [np.zeros(len(t.entries), np.int64) for t in trees]
        s = [np.zeros(t.entries.shape, np.int64) for t in trees]
        for b in batches:
            _, x = matrix(b.column(0), dims)
            for p, t in enumerate(trees):
                own = x[:, p * width : (p + 1) * width]
                at, _ = t.nearest(own)
                n[p] += np.bincount(at, minlength=len(n[p]))
                np.add.at(s[p], at, own)
        part, entry = np.meshgrid(range(len(trees)), range(len(n[0])), indexing="ij")
        used = np.stack(n).ravel() > 0
        yield pa.RecordBatch.from_arrays([pa.array(part.ravel()[used], pa.int32()), pa.array(entry.ravel()[used], pa.int32()), pa.array(np.stack(n).ravel()[used], pa.int64()), pa.array(list(np.stack(s).reshape(-1, width)[used]), pa.list_(pa.int64()))], ["part", "entry", "n", "s"])

    made = rows.select("v").mapInArrow(run, "part int, entry int, n long, s array<long>")
    width = dims // len(books)
    return made.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i]) for i in range(width)]).alias("s"))


def learn(rows: DataFrame, entries: int, parts: int, rounds: int) -> tuple[list[np.ndarray], int]:
    """Codebooks of all parts (``entries`` vectors in all, held on the driver) and the vectors' length."""
    first = rows.filter("id is not null and size(v) > 0").groupBy("id").agg(F.min("v").alias("v")).orderBy("id").limit(entries).collect()  # ``entries`` rows
    dims = len(first[0]["v"]) if first else 0
    if dims == 0:
        return [], 0
    start = np.array([r["v"] for r in first if len(r["v"]) == dims], np.int64).reshape(-1, dims)
    if dims % parts:
        raise ValueError(f"vectors of {dims} components can't be cut into {parts} equal parts")
    width = dims // parts
    books = [start[:, p * width : (p + 1) * width].copy() for p in range(parts)]
    for _ in range(rounds):
        for r in partial_sums(rows, books, dims).collect():  # parts x entries rows at most
            books[r["part"]][r["entry"]] = [x // r["n"] for x in r["s"]]
    return books, dims


def assigned(rows: DataFrame, books: list[np.ndarray], dims: int) -> DataFrame:
    """Add ``code`` and ``error``; both null for vectors of another length than the codebooks'."""
    sent = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [BallTree(b) for b in sent.value]
        for b in batches:
            fit, x = matrix(b.column(2), dims)
            found = [t.nearest(x[:, p * dims // len(trees) : (p + 1) * dims // len(trees)]) for p, t in enumerate(trees)]
            code, error = np.full(len(fit), None, object), np.full(len(fit), None, object)
            if fit.any():
                code[fit] = ["".join(f"{k:02x}" for k in ks) for ks in zip(*(at.tolist() for at, _ in found), strict=True)]
                error[fit] = np.sum([d for _, d in found], axis=0).tolist()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(code, pa.string()), pa.array(error, pa.int64())], ["id", "label", "code", "error"])

    return rows.mapInArrow(run, f"id long, label {rows.schema['label'].dataType.simpleString()}, code string, error long")


def with_label_error(rows: DataFrame) -> DataFrame:
    """Add the sum of ``error`` over the rows of a label (nulls together), though one label may hold most rows.

    Labels with over a ``HOT``-th of the rows, fewer than ``HOT``, are broadcast; the others are joined by a shuffle.
    """
    sums = staged(rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "codes-labels")
    most = (sums.agg(F.sum("n")).first()[0] or 0) // HOT + 1
    sums = sums.withColumnRenamed("label", "of")
    same: Column = F.col("label").eqNullSafe(F.col("of"))
    hot = rows.join(F.broadcast(sums.filter(F.col("n") > most).withColumnRenamed("label_error", "hot_error").drop("n")), same, "left").drop("of")
    inner = hot.filter("hot_error is not null").withColumn("label_error", F.col("hot_error"))
    rest = hot.filter("hot_error is null").join(sums.filter(F.col("n") <= most).drop("n"), same, "left").drop("of")
    return inner.unionByName(rest).drop("hot_error")


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", entries: int = 256, parts: int = 4, rounds: int = 4) -> DataFrame:
    """Vector codes: id, code, error, label_error, codebooks_sha256.

    Each codebook starts as that part of the vectors of the ``entries`` smallest identifiers. In each round every part goes to its
    nearest entry (ties to the lower index), found by branch and bound in a ball tree over the codebook, and every used entry becomes
    the floor of its parts' mean. All is integer arithmetic; sums of a round are added up in tasks, then by Spark; the driver holds codebooks alone.

    Rows with a null vector, or null or non-finite components, are dropped. Components from 2^18 on stop the query (their distances could pass
    64 bits). Repeated rows are coded one by one and count each time; of rows with one identifier the least vector starts an entry. A null identifier is coded but starts none.
    Vectors of another length than that of the smallest identifier get null code and error. Fewer rows than ``entries`` give smaller codebooks; an empty
    table (or one without any identifier) gives no rows. Other columns are not read.
    """
    rows = staged(integers(vectors, id_col, vector_col, label_col), "codes-integers")
    books, dims = learn(rows, entries, parts, rounds)
    told = hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()
    if not books:
        rows = rows.limit(0).select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        return rows.select(F.col("id").alias(id_col), "code", "error", F.col("error").alias("label_error"), F.lit(told).alias("codebooks_sha256"))
    coded = staged(assigned(rows, books, dims), "codes-assigned")
    return with_label_error(coded).select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(told).alias("codebooks_sha256"))


def sql(rounds: int = 4) -> str:
    """The same by exhaustive search, for vectors of 64 components."""
    out = ["""v AS MATERIALIZED (SELECT vec_id, label, [floor(x::DOUBLE * 1024) for x in embedding] AS v FROM embeddings WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0)""",
           """p AS MATERIALIZED (SELECT vec_id, label, q, v[q * 16 + 1:q * 16 + 16] AS x FROM v, (SELECT unnest([0, 1, 2, 3]) AS q))""",
           """b0 AS MATERIALIZED (SELECT q, (dense_rank() OVER (ORDER BY vec_id) - 1)::INT AS e, x AS y FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 256))"""]  # fmt: skip
    nearest = "a{0} AS MATERIALIZED (SELECT vec_id, label, q, x, (min({{'d': d, 'e': e}})).e AS e, min(d) AS d FROM (SELECT p.*, e, list_inner_product(x, x) + list_inner_product(y, y) - 2 * list_inner_product(x, y) AS d FROM p JOIN b{0} USING (q)) GROUP BY ALL)"
    for r in range(rounds):
        out.append(nearest.format(r).replace("{{", "{").replace("}}", "}"))
        out.append(f"m{r} AS MATERIALIZED (SELECT q, e, list(m ORDER BY i) AS y FROM (SELECT q, e, i, floor(sum(x[i]) / count(*)) AS m FROM a{r}, (SELECT unnest(range(1, 17)) AS i) GROUP BY q, e, i) GROUP BY q, e)")
        out.append(f"b{r + 1} AS MATERIALIZED (SELECT q, e, coalesce(m.y, b.y) AS y FROM b{r} b LEFT JOIN m{r} m USING (q, e))")
    out.append(nearest.format(rounds).replace("{{", "{").replace("}}", "}"))
    out.append("c AS (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY q) AS code, sum(d)::BIGINT AS error FROM a4 GROUP BY ALL)")
    out.append("h AS (SELECT sha256(string_agg(y[i]::BIGINT::VARCHAR, ',' ORDER BY q, e, i)) AS codebooks_sha256 FROM b4, (SELECT unnest(range(1, 17)) AS i))")
    return f"WITH {', '.join(out)} SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM c, h"


SQL = sql()


def op12_vector_codes(spark, sf_dir):
    """Codes of all embeddings: 4 parts, 256 entries, 4 rounds."""
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
