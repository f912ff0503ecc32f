"""Queries over random draws, training samples and template matches."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from gridloom.operators import sampling as R
from gridloom.operators import stencil as S
from gridloom.operators import templates as M
from gridloom.plans.stencil_queries import EDGES, GRAD, distances
from gridloom.registry import query
from gridloom.sources import tables as T


def u(key, seed):
    """The uniform draw as SQL."""
    x = f"((({key}) % 1000003 * {2 * seed + 2654435761} + {seed * 40503}) % 1000003)"
    return f"(({x} * {x} % 1000003) * ({x} * {x} % 1000003) % 1000003 * {x} % 1000003 / 1000003.0::DOUBLE)"


def vec():
    return F.col("vec_id")


@query("A20_bernoulli", f"SELECT vec_id, {u('vec_id', 3)} < 0.3 AS hit FROM embeddings")
def a20bernoulli(spark, sf):
    return T.table(spark, sf, "embeddings").select("vec_id", R.test(vec(), 3, 0.3).alias("hit"))


@query("A20_normal", f"SELECT vec_id, round(sqrt(-2 * ln({u('vec_id', 5)} + 0.5 / 1000003)) * cos(2 * pi() * {u('vec_id', 6)}), 6) + 0.0 AS x FROM embeddings")
def a20normal(spark, sf):
    return T.table(spark, sf, "embeddings").select("vec_id", (F.round(R.normal(vec(), 5), 6) + 0.0).alias("x"))


@query("A20_random_distribution", f"WITH x AS (SELECT vec_id, i, pow({u('vec_id * 6 + i', 9)} + 0.5 / 1000003, 3) AS p FROM embeddings, (SELECT unnest(range(0, 6)) AS i)) SELECT vec_id, i::INT AS i, round(p / sum(p) OVER (PARTITION BY vec_id), 6) AS p FROM x")
def a20distribution(spark, sf):
    return T.table(spark, sf, "embeddings").select("vec_id", F.posexplode(R.distribution(vec(), 9, 6)).alias("i", "p")).withColumn("p", F.round("p", 6))


# --- training samples ---------------------------------------------------------------------------

GRID = "s AS (SELECT image_id, r, c, label, image_id * 64 + r * 8 + c AS k FROM labels_r WHERE r BETWEEN 1 AND 6 AND c BETWEEN 2 AND 5 AND (r - 1) % 2 = 0 AND (c - 2) % 2 = 0)"


def cell_key():
    return F.col("image_id") * 64 + F.col("r") * 8 + F.col("c")


def samples(spark, sf):
    return R.grid_samples(T.labels(spark, sf), 2, 1, 2)


@query("M19_supervision", f"WITH {GRID}, d AS (SELECT image_id, list_sort(list(DISTINCT label)) AS labels FROM labels_r GROUP BY image_id) SELECT s.image_id, r, c, label AS full_, labels[1 + floor({u('k', 11)} * len(labels))::INT] AS part, floor({u('k', 12)} * 20)::INT AS none FROM s JOIN d ON d.image_id = s.image_id")
def m19modes(spark, sf):
    """The labels that grid samples get under each mode of supervision."""
    s, labels, cell = samples(spark, sf), T.labels(spark, sf), ["image_id", "r", "c"]
    full = R.supervised(s, labels, "full", cell_key(), 0).withColumnRenamed("label", "full_")
    part = R.supervised(s, labels, "part", cell_key(), 11).withColumnRenamed("label", "part")
    none = R.supervised(s, labels, "none", cell_key(), 12).withColumnRenamed("label", "none")
    return full.join(part, cell).join(none, cell)


@query("M19_splits_by_point", f"WITH {GRID} SELECT image_id, r, c, label, split::INT AS split FROM s, (SELECT unnest([0, 1, 2]) AS split) WHERE {u('k * 3 + split', 13)} < 0.4")
def m19points(spark, sf):
    return R.split_samples(samples(spark, sf), 3, cell_key(), 13, 0.4)


@query("M19_splits_by_image", f"WITH {GRID} SELECT image_id, r, c, label, split::INT AS split FROM s, (SELECT unnest([0, 1, 2]) AS split) WHERE {u('k * 3 + split', 13)} < 0.8 AND {u('image_id * 3 + split', 20)} < 0.5")
def m19images(spark, sf):
    return R.split_samples(samples(spark, sf), 3, cell_key(), 13, 0.8, 0.5)


# --- templates ------------------------------------------------------------------------------------

POINTS = [(0.0, 0.0, 0.1), (1.0, 0.0, 0.6), (2.0, 1.0, 1.2), (2.5, 2.0, 2.0), (1.0, 3.5, 5.0)]
#: Where the template lies as it is, where it is moved to, and moved and stretched, for each image.
PLACED = f"""t(x, y, angle) AS (VALUES {', '.join(str(p) for p in POINTS)}), q AS (SELECT vec_id AS image_id, kind, CASE kind WHEN 0 THEN 0 ELSE (vec_id % 7)::INT - 1 END AS r0, CASE kind WHEN 0 THEN 0 ELSE (vec_id % 5)::INT END AS c0, CASE kind WHEN 2 THEN 1.5 ELSE 1.0 END AS sx, CASE kind WHEN 2 THEN 0.8 ELSE 1.0 END AS sy FROM embeddings, (SELECT unnest([0, 1, 2]) AS kind)),
p AS (SELECT image_id, kind, trunc(y::DOUBLE * sy::DOUBLE + r0)::INT AS r, trunc(x::DOUBLE * sx::DOUBLE + c0)::INT AS c, angle::DOUBLE AS angle FROM q, t),
near AS (SELECT p.image_id, kind, angle, p.r, p.c, (min({{'d': (b.r - p.r) ** 2 + (b.c - p.c) ** 2, 'r': b.r, 'c': b.c}})) AS e, p.x FROM (SELECT *, row_number() OVER () AS x FROM p WHERE r BETWEEN 0 AND 7 AND c BETWEEN 0 AND 7) p JOIN b ON b.image_id = p.image_id GROUP BY ALL)"""


def placements(spark, sf):
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(sx).alias("sx"), F.lit(sy).alias("sy")) for k, (sx, sy) in enumerate([(1.0, 1.0), (1.0, 1.0), (1.5, 0.8)])]))
    moved = lambda x: F.when(F.col("k.kind") == 0, 0).otherwise(x).cast("int")
    rows = T.table(spark, sf, "embeddings").select("vec_id", kinds.alias("k"))
    return rows.select(F.struct("vec_id", "k.kind").alias("key"), F.col("vec_id").alias("image_id"), F.lit(1).alias("template"), moved(vec() % 7 - 1).alias("row"), moved(vec() % 5).alias("column"), "k.sx", "k.sy")


def template(spark):
    return F.broadcast(spark.createDataFrame([(1, *p) for p in POINTS], "template int, x double, y double, angle double"))


@query("W14_nearest_edges", f"WITH {EDGES}, {PLACED} SELECT image_id, kind, r, c, e.r AS nr, e.c AS nc, e.d::BIGINT AS d FROM near")
def w14points(spark, sf):
    """The nearest edge of each point of the placed templates."""
    out = M.nearest_edges(distances(spark, sf), M.placed(template(spark), placements(spark, sf)))
    return out.select("image_id", "key.kind", "r", "c", "nr", "nc", "d")


@query("W15_chamfer_overloads", f"WITH {EDGES}, {PLACED} SELECT image_id, kind, round(avg(least(sqrt(e.d), 3.0)) / 3.0, 6) AS score FROM near GROUP BY ALL")
def w15all(spark, sf):
    """Templates as they lie, moved, and moved and stretched."""
    return M.chamfer_match(distances(spark, sf), template(spark), placements(spark, sf), 3).select("image_id", "key.kind", F.round("score", 6).alias("score"))


@query("W16_orientation_overloads", f"WITH {EDGES}, {GRAD}, {PLACED}, o AS (SELECT near.image_id, kind, abs((CASE WHEN atan2(gy, gx) < 0 THEN atan2(gy, gx) + 2 * pi() ELSE atan2(gy, gx) END) - angle) AS a FROM near JOIN g ON g.image_id = near.image_id AND g.r = e.r AND g.c = e.c), f AS (SELECT image_id, kind, CASE WHEN a > pi() THEN a - pi() ELSE a END AS a FROM o) SELECT image_id, kind, round(avg(CASE WHEN a > pi() / 2 THEN pi() - a ELSE a END) / (pi() / 2), 5) AS score FROM f GROUP BY ALL")
def w16all(spark, sf):
    g = S.gradient(T.raster(spark, sf))
    return M.orientation_match(distances(spark, sf), g, template(spark), placements(spark, sf)).select("image_id", "key.kind", F.round("score", 5).alias("score"))


# --- blurs ----------------------------------------------------------------------------------------


def blur_sql(source: str, into: str, sigma: float, side: int, step: int = 1) -> str:
    """A Gaussian blur by its formula, along rows and then columns, of every ``step``-th cell."""
    n, out = math.ceil(3 * sigma), -(-side // step)
    taps = f"(SELECT k, exp(-k * k / (2 * {sigma!r}::DOUBLE ** 2)) / sum(exp(-k * k / (2 * {sigma!r}::DOUBLE ** 2))) OVER () AS w FROM (SELECT unnest(range({-n}, {n + 1})) AS k))"
    line = lambda src, a, b: f"SELECT s.image_id, s.{b}, o.i::INT AS {a}, sum(w * v) AS v FROM {src} s JOIN (SELECT i, greatest(least(i * {step} + k, {side - 1}), 0) AS at, w FROM {taps}, (SELECT unnest(range(0, {out})) AS i)) o ON s.{a} = o.at GROUP BY ALL"
    return f"{into}_c AS MATERIALIZED ({line(source, 'c', 'r')}), {into} AS MATERIALIZED ({line(f'{into}_c', 'r', 'c')})"


@query("W7_blurred_gradient", f"WITH {blur_sql('raster', 'blurred', 1.414, 8)}, {GRAD.replace('raster', 'blurred')} SELECT image_id, r, c, round(gx, 6) + 0.0 AS gx, round(gy, 6) + 0.0 AS gy, round(sqrt(gx * gx + gy * gy), 6) AS magnitude FROM g")
def w7blurred(spark, sf):
    """The gradient after the usual blur."""
    g = S.gradient(S.separable(T.raster(spark, sf), S.gaussian_kernel(1.414)))
    return g.select("image_id", "r", "c", (F.round("gx", 6) + 0.0).alias("gx"), (F.round("gy", 6) + 0.0).alias("gy"), F.round("magnitude", 6).alias("magnitude"))


def pyramid_sql(levels: int = 3, least: int = 4, sigma: float = 1.6, side: int = 8) -> str:
    m, steps, out, octave = math.sqrt(2 ** (2 / levels) - 1), [blur_sql("raster", "o0", sigma, side)], [], 0
    while side >= least:
        name = f"o{octave}"
        for k in range(levels):
            if k:
                steps.append(blur_sql(name, f"o{octave}_{k}", sigma * m**k, side))
                name = f"o{octave}_{k}"
            out.append(f"SELECT {octave} AS octave, {k} AS level, image_id, r, c, round(v, 7) AS v FROM {name}")
        steps.append(blur_sql(f"o{octave}", f"o{octave + 1}", 2 * sigma, side, 2))
        side, octave = (side + 1) // 2, octave + 1
    return f"WITH {', '.join(steps)} {' UNION ALL '.join(out)}"


@query("W20_pyramid_values", pyramid_sql())
def w20values(spark, sf):
    """The scale-space pyramid, held against its blurs by formula."""
    return S.scale_space(T.raster(spark, sf), 8, 3, 4, 1.6).withColumn("v", F.round("v", 7))
