"""Queries over the neighbourhood operators."""

from __future__ import annotations

import json
import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions import filters
from gridloom.operators import banks as B
from gridloom.operators import patches as Z
from gridloom.operators import pixels as P
from gridloom.operators import stencil as S
from gridloom.plans.pixel_queries import CELL, rounded
from gridloom.registry import query
from gridloom.sources import tables as T
from gridloom.sources.staging import staged

INTEGRAL = """integral AS (SELECT image_id, r + 1 AS r, c + 1 AS c, sum(v) OVER (PARTITION BY image_id, c ORDER BY r) AS v FROM (SELECT image_id, r, c, sum(v) OVER (PARTITION BY image_id, r ORDER BY c) AS v FROM raster)
UNION ALL SELECT image_id, 0, k::INT, 0.0 FROM (SELECT DISTINCT image_id FROM raster), (SELECT unnest(range(0, 9)) AS k) UNION ALL SELECT image_id, k::INT, 0, 0.0 FROM (SELECT DISTINCT image_id FROM raster), (SELECT unnest(range(1, 9)) AS k))"""


@query("W1_integral_image", f"WITH {INTEGRAL} SELECT image_id, r::INT AS r, c::INT AS c, round(v, 6) + 0.0 AS v FROM integral")
def w1(spark, sf):
    return S.integral(T.raster(spark, sf)).withColumn("v", F.round("v", 6) + 0.0)


RECTS = [(1, 0, 0, 3, 4), (2, 2, 3, 4, 2), (3, -2, -1, 5, 5), (4, 6, 6, 9, 9), (5, 7, 7, 0, 0)]


def rect_values():
    return ", ".join(map(str, RECTS))


@query("W2_rectangle_sums", f"""WITH q(key, r0, c0, h, w) AS (VALUES {rect_values()}), k AS (SELECT key, greatest(least(r0, 7), 0) AS t, greatest(least(c0, 7), 0) AS l, greatest(least(r0 + h, 8), 0) AS b, greatest(least(c0 + w, 8), 0) AS e FROM q)
SELECT key::BIGINT AS key, image_id, round(sum(v), 6) AS v FROM k JOIN raster ON r >= t AND r < greatest(b, t + 1) AND c >= l AND c < greatest(e, l + 1) GROUP BY key, image_id""")
def w2(spark, sf):
    table = T.raster(spark, sf)
    wanted = table.select("image_id").distinct().withColumn("q", F.explode(F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(q, ("key", "r0", "c0", "height", "width"), strict=True)]) for q in RECTS]))).select("image_id", "q.*")
    return rounded(S.rectangle_sums(S.integral(table), wanted, 8, 8).withColumn("key", F.col("key").cast("long")), "v")


MIRROR = "CASE WHEN {i} < 0 THEN -({i}) - 1 WHEN {i} >= 8 THEN 15 - ({i}) ELSE {i} END"
CLAMP = "greatest(least({i}, 7), 0)"


def separable_sql(kernel, border, source="raster", step=1, name="s"):
    half = len(kernel) // 2
    k = "k{n}(o, w) AS (VALUES {v})".format(n=name, v=", ".join(f"({i - half}, {w!r}::DOUBLE)" for i, w in enumerate(kernel)))
    at = lambda axis: border.format(i=f"(g.i * {step} + k.o)")
    n = -(-8 // step)
    grid = f"(SELECT unnest(range(0, {n})) AS i) g"
    h = f"{name}h AS (SELECT a.image_id, a.r, g.i AS c, sum(k.w * a.v) AS v FROM k{name} k, {grid} JOIN {source} a ON a.c = {at('c')} GROUP BY a.image_id, a.r, g.i)"
    v = f"{name} AS (SELECT a.image_id, g.i::INT AS r, a.c::INT AS c, sum(k.w * a.v) AS v FROM k{name} k, {grid} JOIN {name}h a ON a.r = {at('r')} GROUP BY a.image_id, g.i, a.c)"
    return f"{k}, {h}, {v}"


HALF = [0.4, 0.2, 0.1]


@query("W3_convolve_mirror", f"WITH {separable_sql(S.half_kernel(HALF), MIRROR)} SELECT image_id, r, c, round(v, 6) AS v FROM s")
def w3(spark, sf):
    return rounded(S.separable(T.raster(spark, sf), S.half_kernel(HALF), S.mirrored), "v")


@query("W4_convolve_replicate", f"WITH {separable_sql([0.1, 0.3, 0.4, 0.15, 0.05], CLAMP, step=2)} SELECT image_id, r, c, round(v, 6) AS v FROM s")
def w4(spark, sf):
    df = S.separable(T.raster(spark, sf), [0.1, 0.3, 0.4, 0.15, 0.05], S.clamped, 2)
    return rounded(df, "v")


K2 = [[1.0, 2.0, 0.5], [0.0, -4.0, 1.0], [2.0, -1.0, 0.25]]


def taps(kernel):
    h, w = len(kernel), len(kernel[0])
    return ", ".join(f"({i - h // 2}, {j - w // 2}, {x!r}::DOUBLE)" for i, row in enumerate(kernel) for j, x in enumerate(row))


@query("W5_convolve_2d", f"WITH k(dr, dc, w) AS (VALUES {taps(K2)}) SELECT p.image_id, p.r, p.c, round(sum(k.w * a.v), 6) AS v FROM raster p, k JOIN raster a ON a.image_id = p.image_id AND a.r = p.r + k.dr AND a.c = p.c + k.dc WHERE p.r BETWEEN 1 AND 6 AND p.c BETWEEN 1 AND 6 GROUP BY p.image_id, p.r, p.c")
def w5(spark, sf):
    return rounded(S.stencil2d(T.raster(spark, sf), K2), "v")


def kernel_values(kernel):
    half = len(kernel) // 2
    return ", ".join(f"({i - half}, {w!r}::DOUBLE)" for i, w in enumerate(kernel))


G1 = S.gaussian_kernel(1.0)


@query("W6_gaussian_smooth_1d", f"WITH k(o, w) AS (VALUES {kernel_values(G1)}) SELECT p.image_id, p.r, p.c, round(sum(k.w * a.v), 6) AS v FROM raster p, k JOIN raster a ON a.image_id = p.image_id AND a.r = p.r AND a.c = {MIRROR.format(i='(p.c + k.o)')} GROUP BY p.image_id, p.r, p.c")
def w6(spark, sf):
    return rounded(S.convolved(T.raster(spark, sf), G1, "c", S.mirrored).select(*CELL, "v"), "v")


GRAD = """g AS (SELECT image_id, r, c, coalesce(lead(v) OVER x, v) - coalesce(lag(v) OVER x, v) AS gx, coalesce(lead(v) OVER y, v) - coalesce(lag(v) OVER y, v) AS gy FROM raster WINDOW x AS (PARTITION BY image_id, r ORDER BY c), y AS (PARTITION BY image_id, c ORDER BY r))"""


@query("W7_gradient", f"WITH {GRAD} SELECT image_id, r, c, round(gx, 6) AS gx, round(gy, 6) AS gy, round(sqrt(gx * gx + gy * gy), 6) AS magnitude, round(CASE WHEN atan2(gy, gx) < 0 THEN atan2(gy, gx) + 2 * pi() ELSE atan2(gy, gx) END, 5) AS direction FROM g")
def w7(spark, sf):
    return rounded(S.gradient(T.raster(spark, sf)), "gx", "gy", "magnitude").withColumn("direction", F.round("direction", 5))


@query("W8_second_moments", f"WITH {GRAD} SELECT image_id, r, c, round(gx * gx, 6) AS xx, round(gy * gy, 6) AS yy, round(gx * gy, 6) + 0.0 AS xy FROM g")
def w8(spark, sf):
    return rounded(S.moments(S.gradient(T.raster(spark, sf))), "xx", "yy", "xy").withColumn("xy", F.col("xy") + 0.0)


def blurred(name, expr):
    return f"m{name} AS (SELECT image_id, r, c, {expr} AS v FROM g), " + separable_sql(G1, CLAMP, f"m{name}", name=name)


EIGEN = f"""{GRAD}, {blurred('xx', 'gx * gx')}, {blurred('yy', 'gy * gy')}, {blurred('xy', 'gx * gy')}, e AS (SELECT a.image_id, a.r, a.c, a.v + b.v + sqrt(4 * d.v * d.v + (a.v - b.v) * (a.v - b.v)) AS l1, a.v + b.v - sqrt(4 * d.v * d.v + (a.v - b.v) * (a.v - b.v)) AS l2
FROM xx a JOIN yy b USING (image_id, r, c) JOIN xy d USING (image_id, r, c))"""


@query("W9_eigensystem", f"WITH {EIGEN} SELECT image_id, r, c, round(l1, 6) AS l1, round(l2, 6) + 0.0 AS l2 FROM e")
def w9(spark, sf):
    df = S.eigensystem(S.moments(S.gradient(T.raster(spark, sf)))).select(*CELL, "l1", "l2")
    return rounded(df, "l1", "l2").withColumn("l2", F.col("l2") + 0.0)


@query("W10_harris", f"WITH {EIGEN} SELECT image_id, r, c FROM e WHERE l1 > 0.02 AND l2 > 0.02")
def w10(spark, sf):
    return S.eigensystem(S.moments(S.gradient(T.raster(spark, sf)))).filter("l1 > 0.02 and l2 > 0.02").select(*CELL)


def around(dr, dc):
    return f"(SELECT magnitude FROM m n WHERE n.image_id = m.image_id AND n.r = m.r + {dr} AND n.c = m.c + {dc})"


NMS = f"""{GRAD}, m AS (SELECT *, sqrt(gx * gx + gy * gy) AS magnitude FROM g),
n AS (SELECT m.*, coalesce(least(abs(m.gx), abs(m.gy)) / nullif(greatest(abs(m.gx), abs(m.gy)), 0), 0) AS t, abs(m.gx) >= abs(m.gy) AS flat, m.gx * m.gy >= 0 AS same,
rt.magnitude AS rt, lt.magnitude AS lt, up.magnitude AS up, dn.magnitude AS dn, ur.magnitude AS ur, ul.magnitude AS ul, dr.magnitude AS dr, dl.magnitude AS dl FROM m
{' '.join(f"LEFT JOIN m {n} ON {n}.image_id = m.image_id AND {n}.r = m.r + ({i}) AND {n}.c = m.c + ({j})" for n, i, j in (('rt', 0, 1), ('lt', 0, -1), ('up', -1, 0), ('dn', 1, 0), ('ur', -1, 1), ('ul', -1, -1), ('dr', 1, 1), ('dl', 1, -1)))}),
thin AS (SELECT image_id, r, c, magnitude, coalesce(magnitude > (CASE WHEN flat THEN rt ELSE dn END) * (1 - t) + (CASE WHEN flat THEN CASE WHEN same THEN dr ELSE ur END ELSE CASE WHEN same THEN dr ELSE dl END END) * t
AND magnitude >= (CASE WHEN flat THEN lt ELSE up END) * (1 - t) + (CASE WHEN flat THEN CASE WHEN same THEN ul ELSE dl END ELSE CASE WHEN same THEN ul ELSE ur END END) * t, false) AS keep FROM n)"""


@query("W11_canny_thinning", f"WITH {NMS} SELECT image_id, r, c, keep FROM thin")
def w11(spark, sf):
    thin = S.thinned(S.gradient_packed(T.packed(T.raster(spark, sf))))
    thin = thin.select("image_id", "columns", F.posexplode_outer("thin").alias("i", "x"))  # the inner one would test its array's size first, and make it anew for each cell
    return thin.select("image_id", F.floor(F.col("i") / F.col("columns")).cast("int").alias("r"), (F.col("i") % F.col("columns")).alias("c"), "x.keep")


@query("W11_canny_hysteresis", f"""WITH RECURSIVE {NMS}, q AS (SELECT image_id, quantile_disc(magnitude, 0.8) AS hi FROM m GROUP BY image_id),
weak AS (SELECT image_id, r, c, magnitude > hi AS strong FROM thin JOIN q USING (image_id) WHERE keep AND magnitude > 0.33 * hi),
edge AS (SELECT image_id, r, c FROM weak WHERE strong UNION SELECT w.image_id, w.r, w.c FROM edge e JOIN weak w ON w.image_id = e.image_id AND abs(w.r - e.r) <= 1 AND abs(w.c - e.c) <= 1) SELECT image_id, r, c FROM edge""")
def w11h(spark, sf):
    """Weak edges stay where their component holds a strong one. All of an image is one row, so no cells are sorted or joined."""
    thin = S.thinned(S.gradient_packed(T.packed(T.raster(spark, sf)))).filter("image_id is not null")
    known = F.array_compact(F.transform("thin", lambda x: x["magnitude"]))
    high = F.get(F.sort_array(known), F.greatest(F.ceil(F.lit(0.8) * F.size(known)), F.lit(1)).cast("int") - 1)
    cells = F.filter(F.transform("thin", lambda x, i: F.struct(i.alias("i"), x["magnitude"].alias("m"), x["keep"].alias("keep"))), lambda x: x["keep"] & (x["m"] > 0.33 * F.col("high")))
    weak = thin.withColumn("high", high).select("image_id", "columns", "high", cells.alias("cells"))
    number = lambda cells: F.transform(cells, lambda x: x["i"])
    sides = weak.select("image_id", "columns", number("cells").alias("weak"), number(F.filter("cells", lambda x: x["m"] > F.col("high"))).alias("strong"))
    return S.linked(sides)  # a filter here would be pushed below and repeat the threshold for each cell


@query("W12_connected_components", """WITH RECURSIVE b AS (SELECT image_id, r, c FROM raster WHERE v > 0.05 AND r BETWEEN 1 AND 6 AND c BETWEEN 1 AND 6), p AS (SELECT image_id, r, c, r * 8 + c AS label FROM b
UNION SELECT b.image_id, b.r, b.c, p.label FROM p JOIN b ON b.image_id = p.image_id AND abs(b.r - p.r) <= 1 AND abs(b.c - p.c) <= 1) SELECT image_id, r, c, min(label)::INT AS label FROM p GROUP BY image_id, r, c""")
def w12(spark, sf):
    """The one-cell border of an image is left out."""
    cells = T.raster(spark, sf).filter("v > 0.05 and r between 1 and 6 and c between 1 and 6")
    return S.connected(cells, 8, save=lambda x: staged(x, "components"))


EDGES = "b AS (SELECT image_id, r, c FROM raster WHERE v > 0.1)"


@query("W13_distance_transform", f"WITH {EDGES} SELECT a.image_id, a.r, a.c, min((a.r - b.r) ** 2 + (a.c - b.c) ** 2)::BIGINT AS d FROM raster a JOIN b USING (image_id) GROUP BY a.image_id, a.r, a.c".replace("JOIN b USING (image_id)", "JOIN b ON a.image_id = b.image_id"))
def w13(spark, sf):
    return distances(spark, sf).select(*CELL, "d")


def distances(spark, sf):
    cells = T.raster(spark, sf).withColumn("v", F.col("v") > 0.1)
    return S.distance_transform(cells, None, 8, 8)


@query("W14_nearest_edge", f"WITH {EDGES}, d AS (SELECT a.image_id, a.r, a.c, min({{'d': (a.r - b.r) ** 2 + (a.c - b.c) ** 2, 'nr': b.r, 'nc': b.c}}) AS n FROM raster a JOIN b ON a.image_id = b.image_id GROUP BY ALL) SELECT image_id, r, c, n.nr, n.nc FROM d")
def w14(spark, sf):
    """The nearest edge cell of every cell; of equally near ones the least row, then column."""
    return distances(spark, sf).select(*CELL, "nr", "nc")


TEMPLATE = [(0, 0), (0, 1), (1, 2), (2, 2), (3, 1)]
PLACES = [(0, 0), (2, 1), (5, 5)]


def chamfer(spark, sf):
    cells = F.array(*[F.struct(F.lit(k).alias("place"), F.lit(pr + r).alias("r"), F.lit(pc + c).alias("c")) for k, (pr, pc) in enumerate(PLACES) for r, c in TEMPLATE])
    d = distances(spark, sf)
    return d.select("image_id").distinct().withColumn("t", F.explode(cells)).select("image_id", "t.*").join(d, list(CELL))


@query("W15_chamfer_match", f"""WITH {EDGES}, d AS (SELECT a.image_id, a.r, a.c, sqrt(min((a.r - b.r) ** 2 + (a.c - b.c) ** 2)) AS d FROM raster a JOIN b ON a.image_id = b.image_id GROUP BY a.image_id, a.r, a.c),
t(place, r, c) AS (VALUES {', '.join(f'({k}, {pr + r}, {pc + c})' for k, (pr, pc) in enumerate(PLACES) for r, c in TEMPLATE)}) SELECT image_id, place, round(avg(least(d, 3.0)) / 3.0, 6) AS score FROM d JOIN t USING (r, c) GROUP BY image_id, place""")
def w15(spark, sf):
    """The mean of cut distances over the template's cells inside the image, as a share of the cut."""
    return chamfer(spark, sf).groupBy("image_id", "place").agg(F.round(F.avg(F.least(F.sqrt("d"), F.lit(3.0))) / 3.0, 6).alias("score"))


@query("W16_orientation_match", f"""WITH {GRAD}, t(r, c, a) AS (VALUES {', '.join(f'({r + 2}, {c + 2}, {0.5 * r}::DOUBLE)' for r, c in TEMPLATE)}), x AS (SELECT image_id, abs(atan2(gy, gx) - a) AS d FROM g JOIN t USING (r, c)), y AS (SELECT image_id, d - pi() * floor(d / pi()) AS d FROM x)
SELECT image_id, round(avg(CASE WHEN d > pi() / 2 THEN pi() - d ELSE d END) / (pi() / 2), 5) AS score FROM y GROUP BY image_id""")
def w16(spark, sf):
    t = spark.createDataFrame([(r + 2, c + 2, 0.5 * r) for r, c in TEMPLATE], "r int, c int, a double")
    g = S.gradient(T.raster(spark, sf)).join(F.broadcast(t), ["r", "c"])
    d = F.abs(F.atan2("gy", "gx") - F.col("a"))
    d = d - math.pi * F.floor(d / math.pi)
    return g.groupBy("image_id").agg(F.round(F.avg(F.when(d > math.pi / 2, math.pi - d).otherwise(d)) / (math.pi / 2), 5).alias("score"))


@query("W17_pooling", "SELECT p.image_id, p.r, p.c, max(a.v) AS v FROM raster p JOIN raster a ON a.image_id = p.image_id AND a.r BETWEEN p.r - 2 AND p.r + 1 AND a.c BETWEEN p.c - 2 AND p.c + 1 WHERE p.r % 3 = 0 AND p.c % 3 = 0 GROUP BY p.image_id, p.r, p.c")
def w17(spark, sf):
    return S.pooled(T.raster(spark, sf), 4, 3, 8, 8, F.max("v"))


@query("W18_label_subsample", "WITH n AS (SELECT image_id, r // 2 AS r, c // 2 AS c, label, count(*) AS k FROM labels_r GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY image_id, r, c ORDER BY k DESC, label) AS p FROM n) SELECT image_id, r::INT AS r, c::INT AS c, label FROM o WHERE p = 1")
def w18(spark, sf):
    block = T.labels(spark, sf).select("image_id", F.expr("cast(r div 2 as int)").alias("r"), F.expr("cast(c div 2 as int)").alias("c"), "label")
    return block.groupBy(*CELL, "label").count().groupBy(*CELL).agg((-F.max(F.struct("count", (-F.col("label")).alias("k")))["k"]).alias("label"))


@query("W19_distribution_subsample", "WITH s AS (SELECT image_id, r // 2 AS r, c // 2 AS c, label, sum(p) AS p FROM dist_u GROUP BY ALL) SELECT image_id, r::INT AS r, c::INT AS c, label::INT AS label, round((p + 0.000025) / (sum(p) OVER w + 0.0001), 6) AS p FROM s WINDOW w AS (PARTITION BY image_id, r, c)")
def w19(spark, sf):
    d = T.unnormalised(spark, sf).groupBy("image_id", F.expr("cast(r div 2 as int)").alias("r"), F.expr("cast(c div 2 as int)").alias("c"), "label").agg(F.sum("p").alias("p"))
    return rounded(P.smoothed_distribution(d), "p")


@query("W20_scale_space_pyramid")
def w20(spark, sf, levels: int = 3, least: int = 4, sigma: float = 1.6):
    return S.scale_space(T.raster(spark, sf), 8, levels, least, sigma)


@query("W21_scale_space_samples")
def w21(spark, sf):
    """Ten places of each image's scale space, all octaves alike; hashes decide, so reruns agree."""
    return Z.scale_space_samples(w20(spark, sf), 10, "scale")


@query("W21_uniform_samples")
def w21uniform(spark, sf):
    """Ten places of each image's scale space, all cells alike."""
    return Z.scale_space_samples(w20(spark, sf), 10, "uniform")


@query("W21_sample_patches")
def w21patches(spark, sf):
    """The 5 x 5 patches from three places of each image's scale space on."""
    pyramid = w20(spark, sf)
    return Z.patches(pyramid, Z.scale_space_samples(pyramid, 3, "scale"), 5, 5, ["image_id", "octave", "level"], tile=4)


@query("W21_patches", "WITH q AS (SELECT vec_id AS image_id, (vec_id % 11)::INT - 2 AS r0, (vec_id % 13)::INT - 3 AS c0 FROM embeddings), d AS (SELECT image_id, r0, c0, y.pr::INT AS pr, x.pc::INT AS pc FROM q, (SELECT unnest(range(0, 5)) AS pr) y, (SELECT unnest(range(0, 6)) AS pc) x) SELECT d.image_id, d.pr, d.pc, v FROM d JOIN raster a ON a.image_id = d.image_id AND a.r = greatest(least(r0 + d.pr, 7), 0) AND a.c = greatest(least(c0 + d.pc, 7), 0)")
def w21given(spark, sf):
    """A 5 x 6 patch of each image from a given place on, partly outside, through tiles of 4 x 4 cells."""
    i = F.col("vec_id")
    samples = T.table(spark, sf, "embeddings").select(i.alias("image_id"), (i % 11 - 2).cast("int").alias("r"), (i % 13 - 3).cast("int").alias("c"))
    out = Z.patches(T.raster(spark, sf), samples, 5, 6, ["image_id"], tile=4)
    return out.select("image_id", F.posexplode("patch").alias("i", "v")).select("image_id", F.expr("cast(i div 6 as int)").alias("pr"), (F.col("i") % 6).cast("int").alias("pc"), "v")


@query("W22_hough", """WITH p AS (SELECT s_suppkey AS id, trunc(s_acctbal / 500.0)::BIGINT AS b0, trunc(s_nationkey / 4.0)::BIGINT AS b1 FROM supplier), o(m0, m1) AS (VALUES (0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)) SELECT b0 + m0 AS b0, b1 + m1 AS b1, count(*) AS votes, min(id) AS first FROM p, o GROUP BY ALL""")
def w22(spark, sf):
    p = T.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("x"), F.col("s_nationkey").cast("double").alias("y"))
    return S.hough(p, (500.0, 4.0), ("x", "y"))


HAAR = """rect AS (SELECT unnest(range(0, 8)) AS r), haar AS (SELECT k.kind, a.r::INT AS r, b.r::INT AS c, h.r::INT + 1 AS h, w.r::INT + 1 AS w, k.down, k.across FROM rect a, rect b, rect h, rect w, (VALUES ('two_h', 1, 2), ('two_v', 2, 1), ('three_h', 1, 3), ('three_v', 3, 1), ('four', 2, 2)) k(kind, down, across)
WHERE a.r + (h.r + 1) * k.down <= 8 AND b.r + (w.r + 1) * k.across <= 8)"""


@query("W23_haar_dictionary", f"WITH {HAAR} SELECT kind, r, c, h, w, down, across FROM haar")
def w23(spark, sf):
    return S.haar_dictionary(spark, 8).select("kind", "r", "c", "h", "w", "down", "across")


@query("W24_haar_values", f"WITH {HAAR}, f AS (SELECT * FROM haar WHERE h = 2 AND w = 2) SELECT kind, f.r, f.c, image_id, round(sum(CASE WHEN (((a.r - f.r) // f.h) + ((a.c - f.c) // f.w)) % 2 = 0 THEN v ELSE -v END), 6) AS v FROM f JOIN raster a ON a.r >= f.r AND a.r < f.r + f.h * down AND a.c >= f.c AND a.c < f.c + f.w * across GROUP BY kind, f.r, f.c, image_id")
def w24(spark, sf):
    """The features of height and width 2."""
    return haar_values(spark, sf, S.haar_dictionary(spark, 8).filter("h = 2 and w = 2")).drop("h", "w")


@query("W24_haar_values_whole", f"WITH {HAAR} SELECT kind, f.r, f.c, f.h, f.w, image_id, round(sum(CASE WHEN (((a.r - f.r) // f.h) + ((a.c - f.c) // f.w)) % 2 = 0 THEN v ELSE -v END), 6) AS v FROM haar f JOIN raster a ON a.r >= f.r AND a.r < f.r + f.h * down AND a.c >= f.c AND a.c < f.c + f.w * across GROUP BY kind, f.r, f.c, f.h, f.w, image_id")
def w24whole(spark, sf):
    """The whole dictionary, all positions and sizes."""
    return haar_values(spark, sf, S.haar_dictionary(spark, 8))


def haar_values(spark, sf, f):
    """Alternating sums over the rectangles of each feature, by four lookups a rectangle in the integral image, which is one array a row."""
    part = f.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("down") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("across") - 1)))
    corner = lambda r, c, s: F.struct((F.col("r") + (F.col("i") + r) * F.col("h")).alias("r"), (F.col("c") + (F.col("j") + c) * F.col("w")).alias("c"), F.lit(s).alias("s"))
    corners = F.array(corner(1, 1, 1), corner(0, 1, -1), corner(1, 0, -1), corner(0, 0, 1))
    sign = F.when((F.col("i") + F.col("j")) % 2 == 0, 1).otherwise(-1)
    place = ((F.col("k.r") * (T.SIDE + 1)) + F.col("k.c")).cast("int")
    lookup = part.withColumn("k", F.explode(corners)).groupBy("kind", "r", "c", "h", "w", place.alias("at")).agg(F.sum(F.col("k.s") * sign).cast("double").alias("s"))
    features = lookup.groupBy("kind", "r", "c", "h", "w").agg(F.sort_array(F.collect_list(F.struct("at", "s"))).alias("x"))
    # at most nine corners; what is missing is nought times the zero in front
    nine = [F.coalesce(F.get("x", F.lit(k))[n], F.lit(0)).cast(t).alias(f"{n}{k}") for k in range(9) for n, t in (("at", "int"), ("s", "double"))]
    # the dictionary depends on the side of an image alone
    both = S.integral_packed(T.packed(T.raster(spark, sf))).join(F.broadcast(features.select("kind", "r", "c", "h", "w", *nine)))
    total = sum((F.col(f"s{k}") * F.get("integral", F.col(f"at{k}")) for k in range(1, 9)), F.col("s0") * F.get("integral", F.col("at0")))
    return both.select("kind", "r", "c", "h", "w", "image_id", F.round(total, 6).alias("v"))


@query("W25_zero_mean_patch", "SELECT image_id, r, c, round((v - avg(v) OVER w) / stddev_pop(v) OVER w, 6) AS v FROM raster WHERE r < 5 AND c < 5 WINDOW w AS (PARTITION BY image_id)")
def w25(spark, sf):
    return rounded(S.zero_mean(T.raster(spark, sf).filter("r < 5 and c < 5")), "v")


@query("W25_zero_mean_patch_whole", "SELECT image_id, r, c, round((v - avg(v) OVER w) / stddev_pop(v) OVER w, 6) AS v FROM raster WINDOW w AS (PARTITION BY image_id)")
def w25whole(spark, sf):
    """The patch is the whole image."""
    return rounded(S.zero_mean(T.raster(spark, sf)), "v")


#: The 28 x 28 mask by its geometry: three nested squares, eight cells each, diagonals shared by two.
MASK = """d AS (SELECT y.r - 14 AS dr, x.c - 14 AS dc, y.r - 13.5 AS y, x.c - 13.5 AS x FROM (SELECT unnest(range(0, 28)) AS r) y, (SELECT unnest(range(0, 28)) AS c) x),
h AS (SELECT *, CASE WHEN greatest(abs(x), abs(y)) < 2 THEN 0 WHEN greatest(abs(x), abs(y)) < 6 THEN 1 ELSE 2 END AS ring FROM d),
e AS (SELECT dr, dc, ring, CASE WHEN abs(x) = abs(y) THEN 1 ELSE 2 END AS w, CASE WHEN y < 0 THEN CASE WHEN x < 0 THEN [9, 4, 0] ELSE [10, 5, 1] END ELSE CASE WHEN x < 0 THEN [18, 20, 22] ELSE [19, 21, 23] END END AS cells FROM h WHERE abs(y) >= abs(x)
UNION ALL SELECT dr, dc, ring, CASE WHEN abs(x) = abs(y) THEN 1 ELSE 2 END, CASE WHEN x < 0 THEN CASE WHEN y < 0 THEN [8, 3, 2] ELSE [14, 13, 12] END ELSE CASE WHEN y < 0 THEN [11, 6, 7] ELSE [15, 16, 17] END END FROM h WHERE abs(x) >= abs(y)),
mask AS (SELECT dr, dc, w, cells[ring + 1] AS cell, [1, 4, 8][ring + 1] AS n FROM e), starts AS (SELECT cell, sum(n) OVER (ORDER BY cell) - n AS start FROM (SELECT DISTINCT cell, n FROM mask))"""


@query("W26_contour_descriptor", f"""WITH {GRAD}, {MASK}, q AS (SELECT vec_id AS image_id, (vec_id % 8)::INT AS r, (vec_id // 8 % 8)::INT AS c FROM embeddings),
t AS (SELECT q.image_id, greatest(least(q.r + dr, 7), 0) AS r, greatest(least(q.c + dc, 7), 0) AS c, cell, n, w FROM q, mask),
a AS (SELECT t.image_id, cell, n, w * sqrt(gx * gx + gy * gy) AS m, (CASE WHEN atan2(gy, gx) < 0 THEN atan2(gy, gx) + 2 * pi() ELSE atan2(gy, gx) END) / (2 * pi()) * n - 0.5 AS x FROM t JOIN g USING (image_id, r, c)),
b AS (SELECT image_id, cell, (floor(x)::INT + n) % n AS bin, m * (1 - (x - floor(x))) AS v FROM a UNION ALL SELECT image_id, cell, (floor(x)::INT + 1 + n) % n, m * (x - floor(x)) FROM a)
SELECT image_id, (start + bin)::INT AS place, round(sum(v), 6) AS v FROM b JOIN starts USING (cell) GROUP BY image_id, start + bin HAVING round(sum(v), 6) <> 0""")
def w26(spark, sf):
    """The descriptor of a place of each image: a magnitude is split between the two nearest directions of its cell."""
    i = F.col("vec_id")
    samples = T.table(spark, sf, "embeddings").select(i.alias("key"), i.alias("image_id"), (i % 8).cast("int").alias("r"), (F.floor(i / 8) % 8).cast("int").alias("c"))
    out = Z.contour_descriptors(S.gradient(T.raster(spark, sf)), samples)
    return out.select("image_id", "place", F.round("v", 6).alias("v")).filter("v != 0")


def bank_table(spark, bank):
    rows = [(name, i - len(k) // 2, j - len(k) // 2, float(x)) for name, k in bank.items() for i, row in enumerate(k) for j, x in enumerate(row)]
    return spark.createDataFrame(rows, "filter string, dr int, dc int, w double")


def responses(df, bank, where=None):
    """Filter responses with a replicated border, a row for each cell (where ``where`` holds) and filter.

    An image is one packed row, so cells meet their neighbours without a shuffle; the kernels are literals of fixed size.
    """
    rows = [{"filter": n, "taps": [{"dr": i - len(k) // 2, "dc": j - len(k) // 2, "w": x} for i, row in enumerate(k) for j, x in enumerate(row)]} for n, k in bank.items()]
    kernels = F.from_json(F.lit(json.dumps(rows)), "array<struct<filter: string, taps: array<struct<dr: int, dc: int, w: double>>>>")
    cells = T.packed(df).withColumn("r", F.explode(F.sequence(F.lit(0), F.col("rows") - 1))).withColumn("c", F.explode(F.sequence(F.lit(0), F.col("columns") - 1)))
    cells = (cells.filter(where) if where is not None else cells).withColumn("k", F.explode(kernels))
    at = lambda t: F.get("data", S.clamped(F.col("r") + t["dr"], F.col("rows")) * F.col("columns") + S.clamped(F.col("c") + t["dc"], F.col("columns")))
    value = F.aggregate("k.taps", F.lit(0.0), lambda acc, t: acc + at(t) * t["w"])
    return cells.select("image_id", "r", "c", "k.filter", value.alias("v"))


BANK = {"bar": ("bar", 1.0, 0.4), "edge": ("edge", 1.0, 0.4), "gaussian": ("gaussian", 1.0, 0.0), "laplacian": ("laplacian", 1.0, 0.0)}
KERNELS = {n: filters.kernel(*spec, radius=2) for n, spec in BANK.items()} | {"point": filters.point(2, 1, -1)}


def bank_sql(bank, radius=None, more=""):
    """The kernels by their formulas, numbered in the order of ``bank``: f (id, dr, dc, w). ``more``: further rows of f."""
    long, wide = (radius, radius) if radius else ("ceil(7 * s)", "ceil(3 * s)")
    g = lambda x, s: f"exp(({x}) ** 2 / (-2 * {s} ** 2))"
    across, code = "(sin(o) * dc + cos(o) * dr)", ["edge", "bar", "gaussian", "laplacian"].index
    return f"""k(id, kind, s, o) AS (VALUES {', '.join(f"({i}, {code(kind)}, {s!r}::DOUBLE, {o!r}::DOUBLE)" for i, (kind, s, o) in enumerate(bank.values()))}), z AS (SELECT *, (CASE WHEN kind < 2 THEN {long} ELSE {wide} END)::INT AS reach FROM k),
y AS (SELECT id, kind, s, o, reach, unnest(range(-reach, reach + 1))::INT AS dr FROM z), t AS (SELECT id, kind, s, o, dr, unnest(range(-reach, reach + 1))::INT AS dc FROM y),
raw AS (SELECT id, dr, dc, CASE kind WHEN 0 THEN {g('cos(o) * dc - sin(o) * dr', '(3 * s)')} * -{across} * {g(across, 's')} WHEN 1 THEN {g('cos(o) * dc - sin(o) * dr', '(3 * s)')} * ({across} ** 2 - s * s) * {g(across, 's')}
WHEN 2 THEN exp(-(dr * dr + dc * dc) / (2 * s * s)) ELSE (dr * dr + dc * dc - s * s) * exp(-(dr * dr + dc * dc) / (2 * s * s)) END AS w FROM t),
low AS (SELECT id, dr, dc, w - CASE WHEN min(w) OVER b < 0 THEN avg(w) OVER b ELSE 0 END AS w FROM raw WINDOW b AS (PARTITION BY id)), f AS MATERIALIZED (SELECT id, dr, dc, w / sum(abs(w)) OVER (PARTITION BY id) AS w FROM low{more})"""


def name_sql(bank):
    return f"list_extract([{', '.join(repr(n) for n in bank)}], id + 1) AS filter"


ONE_JOIN = "JOIN raster a ON a.image_id = p.image_id AND a.r = greatest(least(p.r + f.dr, 7), 0) AND a.c = greatest(least(p.c + f.dc, 7), 0)"
POINT = " UNION ALL SELECT 4, y.dr::INT, x.dc::INT, CASE WHEN y.dr = 1 AND x.dc = -1 THEN 1.0 ELSE 0.0 END FROM (SELECT unnest(range(-2, 3)) AS dr) y, (SELECT unnest(range(-2, 3)) AS dc) x"
SMALL, SMALL_NAME = bank_sql(BANK, 2, POINT), name_sql(KERNELS)


@query("W27_filter_kernels", f"WITH {SMALL} SELECT {SMALL_NAME}, dr, dc, round(w, 6) AS w FROM f")
def w27(spark, sf):
    return rounded(bank_table(spark, KERNELS), "w")


@query("W28_filter_response", f"WITH {SMALL}, x AS (SELECT p.image_id, id, sum(f.w * a.v) AS v FROM raster p, f {ONE_JOIN} WHERE p.r = p.image_id % 8 AND p.c = p.image_id // 8 % 8 GROUP BY ALL) SELECT image_id, {SMALL_NAME}, round(v, 5) + 0.0 AS v FROM x")
def w28(spark, sf):
    """The responses at a point of each image."""
    df = responses(T.raster(spark, sf), KERNELS, (F.col("r") == F.col("image_id") % 8) & (F.col("c") == F.floor(F.col("image_id") / 8) % 8))
    return df.select("image_id", "filter", (F.round("v", 5) + 0.0).alias("v"))


#: Kernels of any reach come down to one weight for each pair of cells, as all that lies beyond the border is the border's cell.
FOLDED = "m AS MATERIALIZED (SELECT id, p.r, p.c, greatest(least(p.r + dr, 7), 0) AS sr, greatest(least(p.c + dc, 7), 0) AS sc, sum(w) AS w FROM f, (SELECT y.r, x.c FROM (SELECT unnest(range(0, 8)) AS r) y, (SELECT unnest(range(0, 8)) AS c) x) p GROUP BY ALL), x AS (SELECT image_id, id, m.r, m.c, sum(m.w * a.v) AS v FROM raster a JOIN m ON a.r = sr AND a.c = sc GROUP BY ALL)"
LM, MR = filters.leung_malik(), filters.mr8()


def bank_images(spark, sf):
    return T.packed(T.raster(spark, sf))


@query("W29_leung_malik", f"WITH {bank_sql(LM)}, {FOLDED} SELECT image_id, {name_sql(LM)}, round(max(v), 6) + 0.0 AS largest, round(avg(v), 6) + 0.0 AS mean FROM x GROUP BY image_id, id")
def w29(spark, sf):
    """48 filters at full reach over every cell: the largest and the mean response of an image."""
    df = B.bank_responses(bank_images(spark, sf), LM)
    mean = F.aggregate("data", F.lit(0.0), lambda acc, x: acc + x) / F.size("data")
    return df.select("image_id", "filter", (F.round(F.array_max("data"), 6) + 0.0).alias("largest"), (F.round(mean, 6) + 0.0).alias("mean"))


@query("W29_mr8", f"WITH {bank_sql({n: spec for n, (_, *spec) in MR.items()})}, {FOLDED}, g AS (SELECT image_id, r, c, (CASE WHEN id < 36 THEN id // 6 ELSE id - 30 END)::INT AS band, max(v) AS v FROM x GROUP BY ALL) SELECT image_id, r::INT AS r, c::INT AS c, band, round(v, 6) + 0.0 AS v FROM g")
def w29m(spark, sf):
    """38 filters, 8 responses of every cell: the greatest over each group's orientations."""
    df = B.bank_responses(bank_images(spark, sf), {n: tuple(spec) for n, (_, *spec) in MR.items()})
    groups = spark.createDataFrame([(n, g) for n, (g, *_) in MR.items()], "filter string, band int")
    cells = df.join(F.broadcast(groups), "filter").select("image_id", "band", "columns", F.posexplode("data").alias("i", "v")).groupBy("image_id", "i", "columns", "band").agg(F.max("v").alias("v"))
    return cells.select("image_id", F.expr("cast(i div columns as int)").alias("r"), (F.col("i") % F.col("columns")).cast("int").alias("c"), "band", (F.round("v", 6) + 0.0).alias("v"))


@query("W30_filter_bank_image", f"WITH {SMALL}, x AS (SELECT p.image_id, p.r, p.c, id, sum(f.w * a.v) AS v FROM raster p, f {ONE_JOIN} GROUP BY ALL) SELECT image_id, r, c, {SMALL_NAME}, round(v, 5) + 0.0 AS v FROM x")
def w30(spark, sf):
    return responses(T.raster(spark, sf), KERNELS).withColumn("v", F.round("v", 5) + 0.0)


@query("W31_random_filters")
def w31(spark, sf, count: int = 6):
    """A seeded pick from the bank."""
    return spark.createDataFrame([(n,) for n in filters.leung_malik()], "filter string").orderBy(F.xxhash64(F.lit(31), "filter")).limit(count)


@query("W32_interior_point", """WITH s AS (SELECT image_id, label, r, c, row_number() OVER (PARTITION BY image_id, label ORDER BY c, r) AS k, count(*) OVER (PARTITION BY image_id, label) AS n FROM labels_r), m AS (SELECT image_id, label, c FROM s WHERE k = (n + 1) // 2),
i AS (SELECT s.image_id, s.label, s.c, s.r, s.r - row_number() OVER (PARTITION BY s.image_id, s.label ORDER BY s.r) AS run FROM s JOIN m ON m.image_id = s.image_id AND m.label = s.label AND m.c = s.c), w AS (SELECT image_id, label, c, min(r) AS lo, max(r) AS hi, row_number() OVER (PARTITION BY image_id, label ORDER BY count(*) DESC, min(r)) AS k FROM i GROUP BY image_id, label, c, run)
SELECT image_id, label, ((lo + hi) // 2)::INT AS r, c FROM w WHERE k = 1""")
def w32(spark, sf):
    """The middle of the longest run in the median column of each segment."""
    seg = W.partitionBy("image_id", "label")
    s = T.labels(spark, sf).withColumn("k", F.row_number().over(seg.orderBy("c", "r"))).withColumn("n", F.count("*").over(seg))
    m = s.filter(F.col("k") == F.expr("(n + 1) div 2")).select("image_id", "label", "c")
    runs = s.select("image_id", "label", "r", "c").join(m, ["image_id", "label", "c"]).withColumn("run", F.col("r") - F.row_number().over(seg.orderBy("r")))
    runs = runs.groupBy("image_id", "label", "c", "run").agg(F.min("r").alias("lo"), F.max("r").alias("hi"), F.count("*").alias("n"))
    best = runs.groupBy("image_id", "label").agg(F.max(F.struct("n", (-F.col("lo")).alias("k"), "lo", "hi", "c")).alias("b"))
    return best.select("image_id", "label", F.expr("cast((b.lo + b.hi) div 2 as int)").alias("r"), F.col("b.c").alias("c"))


SPLAT = "s AS (SELECT image_id, r + abs(v) AS y, c + v * v AS x, abs(v) AS w FROM raster), q AS (SELECT image_id, (floor(y) + i)::INT AS r, (floor(x) + j)::INT AS c, w * (1 - abs(y - (floor(y) + i))) * (1 - abs(x - (floor(x) + j))) AS v FROM s, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j)), g AS (SELECT image_id, r, c, sum(v) AS v FROM q WHERE r < 8 AND c < 8 GROUP BY ALL)"


def splatted(spark, sf):
    return S.splat(T.raster(spark, sf).select("image_id", (F.col("r") + F.abs("v")).alias("y"), (F.col("c") + F.col("v") * F.col("v")).alias("x"), F.abs("v").alias("w")), 8, 8)


@query("W33_gibbs_splat", f"WITH {SPLAT} SELECT image_id, r, c, round(v / sum(v) OVER (PARTITION BY image_id), 6) AS v, round(sum(v) OVER (PARTITION BY image_id, r), 5) AS row_sum, round(sum(v) OVER (PARTITION BY image_id, c), 5) AS column_sum FROM g")
def w33(spark, sf):
    g = splatted(spark, sf)
    over = lambda *by: F.sum("v").over(W.partitionBy("image_id", *by))
    return g.select(*CELL, F.round(F.col("v") / over(), 6).alias("v"), F.round(over("r"), 5).alias("row_sum"), F.round(over("c"), 5).alias("column_sum"))


@query("W33_gibbs_samples")
def w33s(spark, sf, samples: int = 5, sweeps: int = 20):
    """Gibbs sampling of a cell from each image: alternately a row given the column and a column given the row."""
    from bisect import bisect_right

    import numpy as np
    import pandas as pd

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = np.zeros((8, 8))
        grid[pdf["r"], pdf["c"]] = pdf["v"]
        rng = np.random.default_rng(int(pdf["image_id"].iloc[0]) + 33)
        out = []
        r, c = np.unravel_index(grid.argmax(), grid.shape)
        # running shares of all columns and rows, so that a draw is one search
        down, along = ((p / p[:, -1:]).tolist() for p in (np.cumsum(g / s, axis=1) for g in (grid.T, grid) for s in [np.where(g.sum(axis=1) > 0, g.sum(axis=1), 1)[:, None]]))
        turns = iter(rng.random(samples * sweeps * 2).tolist())
        for k in range(samples):
            for _ in range(sweeps):
                r = bisect_right(down[c], next(turns))
                c = bisect_right(along[r], next(turns))
            out.append((pdf["image_id"].iloc[0], k, int(r), int(c)))
        return pd.DataFrame(out, columns=["image_id", "k", "r", "c"])

    return splatted(spark, sf).groupBy("image_id").applyInPandas(draw, "image_id long, k int, r int, c int")


@query("W34_random_labels")
def w34(spark, sf):
    """A label for each cell, drawn from its distribution by a hash of the cell."""
    d = P.smoothed_distribution(T.unnormalised(spark, sf))
    cumulative = F.sum("p").over(W.partitionBy(*CELL).orderBy("label"))
    u = F.shiftrightunsigned(F.xxhash64(F.lit(34), *CELL), 11).cast("double") / float(1 << 53)
    return d.withColumn("upto", cumulative).filter(F.col("upto") >= u * (1 - 1e-9)).groupBy(*CELL).agg(F.min("label").alias("label"))
