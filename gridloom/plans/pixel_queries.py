"""Queries over the per-cell maps."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from gridloom.functions import color
from gridloom.operators import pixels as P
from gridloom.registry import query
from gridloom.sources import tables as T

CELL = ("image_id", "r", "c")


def rounded(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


@query("P1_indexer", "SELECT image_id, v FROM raster WHERE r = 2 AND c = 3")
def p1(spark, sf):
    return T.raster(spark, sf).filter("r = 2 and c = 3").select("image_id", "v")


@query("P2_channel", "SELECT image_id, r, c, green AS v FROM rgb")
def p2(spark, sf):
    return T.rgb(spark, sf).select(*CELL, F.col("green").alias("v"))


@query("P3_extract_rectangle", """SELECT a.image_id, t.r::INT AS r, u.c::INT AS c, a.v FROM (SELECT unnest(range(0, 5)) AS r) t, (SELECT unnest(range(0, 6)) AS c) u
JOIN raster a ON a.r = least(greatest(t.r - 2, 0), 7) AND a.c = least(greatest(u.c + 5, 0), 7)""")
def p3(spark, sf):
    return P.extract(T.raster(spark, sf), -2, 5, 5, 6)


@query("P4_fill", "SELECT image_id, r, c, 0.25::DOUBLE AS v FROM raster")
def p4(spark, sf):
    return T.raster(spark, sf).withColumn("v", F.lit(0.25))


@query("P5_threshold", "SELECT image_id, r, c, NOT (v <= 0.05) AS v FROM raster")
def p5(spark, sf):
    return P.threshold(T.raster(spark, sf), 0.05)


@query("P6_invert", "SELECT image_id, r, c, v <= 0 AS v FROM raster")
def p6(spark, sf):
    return P.threshold(T.raster(spark, sf), 0.0).withColumn("v", ~F.col("v"))


@query("P7_gray", """SELECT image_id, r, c, round((least(red, green, blue) + greatest(red, green, blue)) / 2.0 / 255.0, 6) AS gray,
round((red * 0.3 + green * 0.59 + blue * 0.11) / 255.0, 6) AS linear FROM rgb""")
def p7(spark, sf):
    ch = [F.col(x).cast("double") for x in ("red", "green", "blue")]
    return rounded(T.rgb(spark, sf).select(*CELL, color.gray(*ch).alias("gray"), color.gray_linear(*ch).alias("linear")), "gray", "linear")


@query("P8_mono_pack", """SELECT image_id, r, c, (least(red, green, blue) + greatest(red, green, blue)) >> 1 AS mono, (red << 16) | (green << 8) | blue AS packed, red AS red_again, green AS green_again, blue AS blue_again FROM rgb""")
def p8(spark, sf):
    ch = [F.col(x) for x in ("red", "green", "blue")]
    df = T.rgb(spark, sf).select(*CELL, color.mono(*ch).alias("mono"), color.pack24(*ch).alias("packed"))
    return df.withColumns(dict(zip(("red_again", "green_again", "blue_again"), color.unpack24(F.col("packed")), strict=True)))


UNIT = "unit AS (SELECT image_id, r AS row_, c AS col_, red / 255.0 AS r, green / 255.0 AS g, blue / 255.0 AS b FROM rgb)"


@query("P9_rgb_hsv", f"""WITH {UNIT}, m AS (SELECT *, greatest(r, g, b) AS top, greatest(r, g, b) - least(r, g, b) AS d FROM unit),
h AS (SELECT *, CASE WHEN d = 0 THEN 0.0 WHEN top = r THEN (g - b) / d WHEN top = g THEN (b - r) / d + 2 ELSE (r - g) / d + 4 END / 6 AS h FROM m)
SELECT image_id, row_ AS r, col_ AS c, round(CASE WHEN h < 0 THEN h + 1 ELSE h END, 6) AS hue, round(d, 6) AS chroma, round(top, 6) AS value FROM h""")
def p9_hsv(spark, sf):
    return _colors(T.rgb(spark, sf), color.rgb_to_hsv, ("hue", "chroma", "value"))


def _colors(df, f, names, back=None):
    ch = [F.col(x) / 255.0 for x in ("red", "green", "blue")]
    out = f(*ch)
    if back:
        out = back(*out)
    return df.select(*CELL, *[F.round(x, 6).alias(n) for x, n in zip(out, names, strict=True)])


@query("P9_rgb_yuv", """SELECT image_id, r, c, round(red / 255.0 * 0.299 + green / 255.0 * 0.587 + blue / 255.0 * 0.114, 6) AS y,
round(red / 255.0 * -0.14713 + green / 255.0 * -0.28886 + blue / 255.0 * 0.436, 6) AS u, round(red / 255.0 * 0.615 + green / 255.0 * -0.51499 + blue / 255.0 * -0.10001, 6) AS v FROM rgb""")
def p9_yuv(spark, sf):
    return _colors(T.rgb(spark, sf), color.rgb_to_yuv, ("y", "u", "v"))


@query("P9_yuv_rgb", """WITH q AS (SELECT *, red / 255.0 * 0.299 + green / 255.0 * 0.587 + blue / 255.0 * 0.114 AS y,
red / 255.0 * -0.14713 + green / 255.0 * -0.28886 + blue / 255.0 * 0.436 AS u, red / 255.0 * 0.615 + green / 255.0 * -0.51499 + blue / 255.0 * -0.10001 AS w FROM rgb)
SELECT image_id, r, c, round(y + w * 1.13983, 6) AS red, round(y + u * -0.39465 + w * -0.5806, 6) AS green, round(y + u * 2.03211, 6) AS blue FROM q""")
def p9_yuv_back(spark, sf):
    return _colors(T.rgb(spark, sf), color.rgb_to_yuv, ("red", "green", "blue"), color.yuv_to_rgb)


LAB = """WITH t AS (SELECT *, (red * 0.412453 + green * 0.357580 + blue * 0.180423) / 255.0 / 0.950456 AS tx, (red * 0.212671 + green * 0.715160 + blue * 0.072169) / 255.0 AS ty, (red * 0.019334 + green * 0.119193 + blue * 0.950227) / 255.0 / 1.088754 AS tz FROM rgb),
f AS (SELECT *, CASE WHEN tx > 0.008856 THEN pow(tx, 1 / 3.0) ELSE tx * 7.787 + 16 / 116.0 END AS fx, CASE WHEN ty > 0.008856 THEN pow(ty, 1 / 3.0) ELSE ty * 7.787 + 16 / 116.0 END AS fy, CASE WHEN tz > 0.008856 THEN pow(tz, 1 / 3.0) ELSE tz * 7.787 + 16 / 116.0 END AS fz FROM t),
l AS (SELECT *, CASE WHEN ty > 0.008856 THEN fy * 116 - 16 ELSE ty * 903.3 END AS light FROM f), d AS (SELECT *, CASE WHEN light < 20 THEN exp((light - 20) / 5) ELSE 1 END AS fade FROM l)
"""


@query("P9_rgb_lab", LAB + "SELECT image_id, r, c, round(greatest(light, 20), 5) AS l, round((fx - fy) * 500 * fade, 5) AS a, round(least((fy - fz) * 200 * fade, 70), 5) AS b FROM d")
def p9_lab(spark, sf):
    ch = [F.col(x) / 255.0 for x in ("red", "green", "blue")]
    return T.rgb(spark, sf).select(*CELL, *[F.round(x, 5).alias(n) for x, n in zip(color.rgb_to_lab(*ch), "lab", strict=True)])


@query("P9_lab_rgb", """WITH q AS (SELECT image_id, r, c, red / 2.55 AS l, green / 2.0 - 64 AS a, blue / 2.0 - 64 AS b FROM rgb), y AS (SELECT *, CASE WHEN l < 903.3 * 0.008856 THEN l / 903.3 ELSE pow((l + 16) / 116, 3) END AS y FROM q),
f AS (SELECT *, CASE WHEN y > 0.008856 THEN (l + 16) / 116 ELSE y * 7.787 + 16 / 116.0 END AS fy FROM y), x AS (SELECT *, fy + a / 500 AS fx, fy - b / 200 AS fz FROM f),
w AS (SELECT *, 0.950456 * CASE WHEN fx > 0.206893 THEN fx ** 3 ELSE (fx - 16 / 116.0) / 7.787 END AS x, 1.088754 * CASE WHEN fz > 0.206893 THEN fz ** 3 ELSE (fz - 16 / 116.0) / 7.787 END AS z FROM x)
SELECT image_id, r, c, round(greatest(least(x * 3.240479 - y * 1.537150 - z * 0.498535, 1), 0), 5) AS red, round(greatest(least(y * 1.875992 + z * 0.041556 - x * 0.969256, 1), 0), 5) AS green, round(greatest(least(x * 0.055648 - y * 0.204043 + z * 1.057311, 1), 0), 5) AS blue FROM w""")
def p9_lab_back(spark, sf):
    """From lightness 0..100 and a, b of -64..64, made of the raster's channels."""
    out = color.lab_to_rgb(F.col("red") / 2.55, F.col("green") / 2.0 - 64, F.col("blue") / 2.0 - 64)
    return T.rgb(spark, sf).select(*CELL, *[(F.round(x, 5) + 0.0).alias(n) for x, n in zip(out, ("red", "green", "blue"), strict=True)])


@query("P9_hsv_rgb", """SELECT image_id, r, c, round(red / 255.0, 5) AS red, round(green / 255.0, 5) AS green, round(blue / 255.0, 5) AS blue FROM rgb""")
def p9_hsv_round(spark, sf):
    """To hue, chroma and value and back again, so the channels return."""
    ch = [F.col(x) / 255.0 for x in ("red", "green", "blue")]
    h, chroma, v = color.rgb_to_hsv(*ch)
    out = color.hsv_to_rgb(h, F.coalesce(F.try_divide(chroma, v), F.lit(0.0)), v)
    return T.rgb(spark, sf).select(*CELL, *[F.round(x, 5).alias(n) for x, n in zip(out, ("red", "green", "blue"), strict=True)])


#: A channel of hue, saturation and value by its distance on the colour wheel.
WHEEL = "v - v * s * greatest(0, least((({n} + h * 6) % 6), 4 - (({n} + h * 6) % 6), 1))"


@query("P9_hsv_rgb_direct", f"""WITH q AS (SELECT image_id, r AS row, c AS col, red / 255.0::DOUBLE AS h, (green % 256) / 255.0::DOUBLE AS s, blue / 255.0::DOUBLE AS v FROM rgb) SELECT image_id, row AS r, col AS c, round({WHEEL.format(n=5)}, 5) AS red, round({WHEEL.format(n=3)}, 5) AS green, round({WHEEL.format(n=1)}, 5) AS blue FROM q""")
def p9_hsv_back(spark, sf):
    """From hue, saturation and value, made of the raster's channels."""
    out = color.hsv_to_rgb(F.col("red") / 255.0, (F.col("green") % 256) / 255.0, F.col("blue") / 255.0)
    return T.rgb(spark, sf).select(*CELL, *[F.round(x, 5).alias(n) for x, n in zip(out, ("red", "green", "blue"), strict=True)])


@query("P9_whole_yuv", """WITH q AS (SELECT image_id, r, c, red, green % 256 AS green, blue FROM rgb), y AS (SELECT *, floor((66 * red + 129 * green + 25 * blue + 128) / 256.0)::BIGINT + 16 AS y, floor((-38 * red - 74 * green + 112 * blue + 128) / 256.0)::BIGINT + 128 AS u, floor((112 * red - 94 * green - 18 * blue + 128) / 256.0)::BIGINT + 128 AS v FROM q)
SELECT image_id, r, c, y, u, v, greatest(least(floor((298 * (y - 16) + 409 * (v - 128) + 128) / 256.0), 255), 0)::BIGINT AS red, greatest(least(floor((298 * (y - 16) - 100 * (u - 128) - 208 * (v - 128) + 128) / 256.0), 255), 0)::BIGINT AS green, greatest(least(floor((298 * (y - 16) + 516 * (u - 128) + 128) / 256.0), 255), 0)::BIGINT AS blue FROM y""")
def p9_whole_yuv(spark, sf):
    """Luminance and colour differences as whole numbers, and back."""
    y, u, v = color.rgb_to_whole_yuv(F.col("red"), F.col("green") % 256, F.col("blue"))
    there = T.rgb(spark, sf).select(*CELL, y.alias("y"), u.alias("u"), v.alias("v"))
    return there.select("*", *[x.alias(n) for x, n in zip(color.whole_yuv_to_rgb(F.col("y"), F.col("u"), F.col("v")), ("red", "green", "blue"), strict=True)])


@query("P9_chromaticity", "SELECT image_id, r, c, round(red / nullif(red + green + blue, 0), 6) AS share_r, round(green / nullif(red + green + blue, 0), 6) AS share_g, (red + green + blue)::BIGINT AS total, red AS red_again FROM rgb")
def p9_chroma(spark, sf):
    ch = [F.col(x) for x in ("red", "green", "blue")]
    r, g, s = color.rgb_to_chromaticity(*ch)
    return T.rgb(spark, sf).select(*CELL, F.round(r, 6).alias("share_r"), F.round(g, 6).alias("share_g"), s.alias("total"), F.round(color.chromaticity_to_rgb(r, g, s)[0]).cast("long").alias("red_again"))


@query("P10_rescale", "SELECT image_id, r, c, round((v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) * 2 - 1, 6) AS v FROM raster WINDOW w AS (PARTITION BY image_id)")
def p10(spark, sf):
    return rounded(P.rescaled(T.raster(spark, sf), -1.0, 1.0), "v")


@query("P11_normalise", "SELECT image_id, r, c, round((v - avg(v) OVER w) / stddev_pop(v) OVER w, 6) AS v FROM raster WINDOW w AS (PARTITION BY image_id)")
def p11(spark, sf):
    return rounded(P.normalised(T.raster(spark, sf)), "v")


@query("P12_to_bytes", "SELECT image_id, r, c, trunc((greatest(least(v, 0.25), -0.25) + 0.25) / 0.5 * 255)::BIGINT AS v FROM raster")
def p12(spark, sf):
    return P.to_bytes(T.raster(spark, sf), -0.25, 0.25)


HEAT = "CASE WHEN x <= 0.5 THEN 0.0 ELSE 2 * x - 1 END AS red, CASE WHEN x <= 0.5 THEN 2 * x ELSE 2 - 2 * x END AS green, CASE WHEN x <= 0.5 THEN 1 - 2 * x ELSE 0.0 END AS blue"


@query("P13_heat_map", f"WITH s AS (SELECT image_id, r, c, (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) AS x FROM raster WINDOW w AS (PARTITION BY image_id)), h AS (SELECT image_id, r, c, {HEAT} FROM s) SELECT image_id, r, c, round(red, 6) AS red, round(green, 6) AS green, round(blue, 6) AS blue FROM h")
def p13(spark, sf):
    df = P.rescaled(T.raster(spark, sf))
    return df.select(*CELL, *[F.round(x, 6).alias(n) for x, n in zip(color.heat(F.col("v")), ("red", "green", "blue"), strict=True)])


@query("P14_magnitude_map", "SELECT image_id, r, c, round((abs(v) - min(abs(v)) OVER w) / (max(abs(v)) OVER w - min(abs(v)) OVER w), 6) AS v FROM raster WINDOW w AS (PARTITION BY image_id)")
def p14(spark, sf):
    return rounded(P.rescaled(T.raster(spark, sf).withColumn("v", F.abs("v"))), "v")


@query("P15_label_color", """SELECT image_id, r, c, (((label & 1) << 7) | (((label >> 3) & 1) << 6))::INT AS red, ((((label >> 1) & 1) << 7) | (((label >> 4) & 1) << 6))::INT AS green, (((label >> 2) & 1) << 7)::INT AS blue, label AS again FROM labels_r""")
def p15(spark, sf):
    r, g, b = color.label_to_color(F.col("label"))
    return T.labels(spark, sf).select(*CELL, r.alias("red"), g.alias("green"), b.alias("blue"), color.color_to_label(r, g, b).alias("again"))


@query("P16_colors_to_labels", """WITH k AS (SELECT *, (red // 16)::BIGINT AS key, image_id * 64 + r * 8 + c AS pos FROM rgb), f AS (SELECT key, min(pos) AS first FROM k GROUP BY key), d AS (SELECT key, row_number() OVER (ORDER BY first) AS label FROM f)
SELECT image_id, r, c, label::BIGINT AS label FROM k JOIN d USING (key)""")
def p16(spark, sf):
    """Colours get labels in the order in which a scan over the images meets them."""
    df = T.rgb(spark, sf).withColumn("key", F.expr("red div 16")).withColumn("pos", F.col("image_id") * 64 + F.col("r") * 8 + F.col("c"))
    seen = P.numbered(df.groupBy("key").agg(F.min("pos").alias("first")), "first")
    return df.join(seen.select("key", "label"), "key").select(*CELL, "label")


@query("P17_labels_to_colors", "SELECT image_id, r, c, (label * 7 % 256)::INT AS red, (label * 11 % 256)::INT AS green, (label * 13 % 256)::INT AS blue FROM labels_r")
def p17(spark, sf):
    names = spark.range(64).select(F.col("id").cast("int").alias("label"), *[(F.col("id") * k % 256).cast("int").alias(n) for k, n in ((7, "red"), (11, "green"), (13, "blue"))])
    return T.labels(spark, sf).join(F.broadcast(names), "label").select(*CELL, "red", "green", "blue")  # 64 rows


@query("P18_distribution_ops", "SELECT image_id, r, c, label::INT AS label, round(p / 2.0, 6) AS halved, round(p * (label + 1), 6) AS weighted, round(p * p, 6) AS squared FROM dist_u UNION ALL SELECT image_id, r, c, (label + 4)::INT, round(p / 2.0, 6), round(p * (label + 1), 6), round(p * p, 6) FROM dist_u")
def p18(spark, sf):
    d = T.unnormalised(spark, sf)
    other = d.withColumnRenamed("p", "q")
    both = d.join(other, [*CELL, "label"]).select(*CELL, "label", F.round(F.col("p") / 2.0, 6).alias("halved"), F.round(F.col("p") * (F.col("label") + 1), 6).alias("weighted"), F.round(F.col("p") * F.col("q"), 6).alias("squared"))
    return both.unionByName(both.withColumn("label", F.col("label") + 4))


@query("P19_dirichlet_normalise", "SELECT image_id, r, c, label::INT AS label, round((p + 0.000025) / (sum(p) OVER w + 0.0001), 6) AS p FROM dist_u WINDOW w AS (PARTITION BY image_id, r, c)")
def p19(spark, sf):
    return rounded(P.smoothed_distribution(T.unnormalised(spark, sf)), "p")


@query("P20_argmax", "SELECT image_id, r, c, CASE WHEN v > 0 THEN 3 ELSE 0 END::INT AS label FROM raster")
def p20(spark, sf):
    return P.argmax(T.unnormalised(spark, sf))


@query("P21_flip_horizontal", "SELECT image_id, r, 7 - c AS c, v FROM raster")
def p21h(spark, sf):
    return P.flipped(T.raster(spark, sf), "c", 8)


@query("P21_flip_vertical", "SELECT image_id, 7 - r AS r, c, v FROM raster")
def p21v(spark, sf):
    return P.flipped(T.raster(spark, sf), "r", 8)


@query("P22_subsample", "SELECT image_id, (r // 3)::INT AS r, (c // 3)::INT AS c, v FROM raster WHERE r % 3 = 0 AND c % 3 = 0 AND r < 6 AND c < 6")
def p22(spark, sf):
    return P.subsampled(T.raster(spark, sf), 3, 8, 8)


GRID = "g AS (SELECT image_id, r::INT AS r, c::INT AS c, {y} AS y, {x} AS x FROM (SELECT DISTINCT image_id FROM raster), (SELECT unnest(range(0, {n})) AS r), (SELECT unnest(range(0, {n})) AS c))"
BILINEAR = "SELECT g.image_id, g.r, g.c, round({out}, 6) AS v FROM g, (SELECT unnest([0, 1]) AS i) i, (SELECT unnest([0, 1]) AS j) j JOIN raster a ON a.image_id = g.image_id AND a.r = least(greatest(floor(g.y) + i.i, 0), 7) AND a.c = least(greatest(floor(g.x) + j.j, 0), 7) GROUP BY g.image_id, g.r, g.c, g.y, g.x"
WEIGHTED = "sum(a.v * (1 - abs(g.y - (floor(g.y) + i.i))) * (1 - abs(g.x - (floor(g.x) + j.j))))"


@query("P23_scale_nearest", "WITH " + GRID.format(y="r * 8.0 / 5", x="c * 8.0 / 5", n=5) + " SELECT g.image_id, g.r, g.c, a.v FROM g JOIN raster a ON a.image_id = g.image_id AND a.r = least(floor(g.y + 0.5), 7) AND a.c = least(floor(g.x + 0.5), 7)")
def p23n(spark, sf):
    return P.resampled(T.raster(spark, sf), 8, 8, 5, 5, kernel="nearest")


@query("P23_scale_bilinear", "WITH " + GRID.format(y="r * 8.0 / 12", x="c * 8.0 / 12", n=12) + BILINEAR.format(out=WEIGHTED))
def p23b(spark, sf):
    return rounded(P.resampled(T.raster(spark, sf), 8, 8, 12, 12), "v")


B3 = "(CASE WHEN {d} < 1 THEN (4 - 6 * pow({d}, 2) + 3 * pow({d}, 3)) / 6 WHEN {d} < 2 THEN pow(2 - {d}, 3) / 6 ELSE 0 END)"


@query("P23_scale_cubic", "WITH " + GRID.format(y="r * 8.0 / 6", x="c * 8.0 / 6", n=6) + f"""SELECT g.image_id, g.r, g.c, round(sum(a.v * {B3.format(d='abs(g.y - (floor(g.y) + i.i))')} * {B3.format(d='abs(g.x - (floor(g.x) + j.j))')}), 6) AS v
FROM g, (SELECT unnest([-1, 0, 1, 2]) AS i) i, (SELECT unnest([-1, 0, 1, 2]) AS j) j JOIN raster a ON a.image_id = g.image_id AND a.r = least(greatest(floor(g.y) + i.i, 0), 7) AND a.c = least(greatest(floor(g.x) + j.j, 0), 7) GROUP BY g.image_id, g.r, g.c""")
def p23c(spark, sf):
    return rounded(P.resampled(T.raster(spark, sf), 8, 8, 6, 6, kernel="cubic"), "v")


M = (0.9, 0.2, 0.5, -0.1, 1.1, -0.25)


def warp_sql(m):
    y = f"{m[3]} * (c - 4.0) + {m[4]} * (r - 4.0) + {m[5]} + 3.5"
    x = f"{m[0]} * (c - 4.0) + {m[1]} * (r - 4.0) + {m[2]} + 3.5"
    out = f"CASE WHEN g.y BETWEEN 0 AND 7 AND g.x BETWEEN 0 AND 7 THEN {WEIGHTED} ELSE -1 END"
    return "WITH " + GRID.format(y=f"({y})::DOUBLE", x=f"({x})::DOUBLE", n=9) + BILINEAR.format(out=out)


@query("P24_affine_warp", warp_sql(M))
def p24(spark, sf):
    return rounded(P.resampled(T.raster(spark, sf), 8, 8, 9, 9, P.affine_source(M, 8, 8, 9, 9), -1.0), "v")


ROT = (math.cos(0.5), math.sin(0.5), 0.0, -math.sin(0.5), math.cos(0.5), 0.0)


@query("P25_rotate", warp_sql(ROT))
def p25(spark, sf):
    return rounded(P.resampled(T.raster(spark, sf), 8, 8, 9, 9, P.affine_source(ROT, 8, 8, 9, 9), -1.0), "v")


@query("P26_gaussian_noise")
def p26(spark, sf):
    """Noise by Box-Muller from hashes of the cell, so that reruns agree."""
    u = [F.shiftrightunsigned(F.xxhash64(F.lit(k), *CELL), 11).cast("double") / float(1 << 53) for k in (1, 2)]
    return T.raster(spark, sf).withColumn("v", F.col("v") + 0.1 * F.sqrt(-2 * F.ln(1 - u[0])) * F.cos(2 * math.pi * u[1]))


@query("P27_bilinear_lookup", "WITH g AS (SELECT DISTINCT image_id, 0 AS r, 0 AS c, 2.25::DOUBLE AS y, 6.6::DOUBLE AS x FROM raster) SELECT image_id, v FROM (" + BILINEAR.format(out=WEIGHTED) + ")")
def p27(spark, sf):
    return rounded(P.resampled(T.raster(spark, sf), 8, 8, 1, 1, (F.lit(2.25), F.lit(6.6))), "v").select("image_id", "v")


@query("P28_append", "SELECT image_id, r, c, v FROM raster UNION ALL SELECT image_id, r, c + 8, v FROM raster WHERE r < 8")
def p28(spark, sf):
    df = T.raster(spark, sf)
    return P.appended(df, df)


@query("P28_append_centred", "WITH small AS (SELECT * FROM raster WHERE r < 3 AND c < 2), g AS (SELECT image_id, r.r::INT AS r, c.c::INT AS c FROM (SELECT DISTINCT image_id FROM raster), (SELECT unnest(range(0, 8)) AS r) r, (SELECT unnest(range(0, 10)) AS c) c) SELECT g.image_id, g.r, g.c, coalesce(a.v, b.v, 0.0) AS v FROM g LEFT JOIN raster a ON a.image_id = g.image_id AND a.r = g.r AND a.c = g.c LEFT JOIN small b ON b.image_id = g.image_id AND b.r + 2 = g.r AND b.c + 8 = g.c")
def p28centred(spark, sf):
    """A part of 3 x 2 cells to the right of the whole, centred, with zeros around it."""
    df = T.raster(spark, sf)
    return P.appended(df, df.filter("r < 3 and c < 2"))


@query("P28_append_bottom", "WITH small AS (SELECT * FROM raster WHERE r < 2 AND c < 5), g AS (SELECT image_id, r.r::INT AS r, c.c::INT AS c FROM (SELECT DISTINCT image_id FROM raster), (SELECT unnest(range(0, 10)) AS r) r, (SELECT unnest(range(0, 8)) AS c) c) SELECT g.image_id, g.r, g.c, coalesce(a.v, b.v, 0.0) AS v FROM g LEFT JOIN small a ON a.image_id = g.image_id AND a.r = g.r AND a.c + 1 = g.c LEFT JOIN raster b ON b.image_id = g.image_id AND b.r + 2 = g.r AND b.c = g.c")
def p28bottom(spark, sf):
    """The whole below a part of 2 x 5 cells, which is centred."""
    df = T.raster(spark, sf)
    return P.appended(df.filter("r < 2 and c < 5"), df, "bottom")


@query("P29_true_cells", "SELECT image_id, r, c, c - 4 AS x, r - 4 AS y FROM raster WHERE v > 0")
def p29(spark, sf):
    return P.threshold(T.raster(spark, sf), 0.0).filter("v").select(*CELL, (F.col("c") - 4).alias("x"), (F.col("r") - 4).alias("y"))


@query("P30_label_segments", "SELECT image_id, label, count(*) AS cells, min(r * 8 + c)::INT AS first FROM labels_r GROUP BY image_id, label")
def p30(spark, sf):
    """Segments as point lists: here their size and first point, so that rows stay small."""
    found = T.labels(spark, sf).groupBy("image_id", "label").agg(F.array_sort(F.collect_list(F.struct("r", "c"))).alias("points"))
    return found.select("image_id", "label", F.size("points").cast("long").alias("cells"), (F.col("points")[0]["r"] * 8 + F.col("points")[0]["c"]).alias("first"))


@query("P31_data_points", "SELECT image_id, r, c, v, floor(abs(v) * 10)::INT AS label FROM raster WHERE floor(abs(v) * 10) > 0 AND r > 0")
def p31(spark, sf):
    """Labelled points without background; cells of the first row are not valid."""
    return T.raster(spark, sf).filter("r > 0").join(T.labels(spark, sf).filter("label > 0"), list(CELL))


@query("P31_background_full", "SELECT image_id, r, c, v, floor(abs(v) * 10)::INT AS label FROM raster WHERE r > 0")
def p31full(spark, sf):
    """Background cells (label 0) stay as points of their own."""
    return T.raster(spark, sf).filter("r > 0").join(T.labels(spark, sf), list(CELL))


@query("P31_background_half", "SELECT image_id, r, c, v, floor(abs(v) * 10)::INT AS label FROM raster WHERE r > 0 AND (floor(abs(v) * 10) > 0 OR ((image_id * 64 + r * 8 + c) * 2654435761) % 1000003 < 500001)")
def p31half(spark, sf):
    """Of the background about half stays, chosen by an arithmetic hash of the cell."""
    some = ((F.col("image_id") * 64 + F.col("r") * 8 + F.col("c")) * 2654435761) % 1000003 < 500001
    return T.raster(spark, sf).filter("r > 0").join(T.labels(spark, sf), list(CELL)).filter((F.col("label") > 0) | some)


@query("P32_random_subset", "SELECT id FROM points ORDER BY (id * 2654435761) % 1000003, id LIMIT 50")
def p32(spark, sf):
    """A sampling operator: the 50 points with the least arithmetic hash."""
    return T.points(spark, sf).orderBy((F.col("id") * 2654435761) % 1000003, "id").limit(50).select("id")
