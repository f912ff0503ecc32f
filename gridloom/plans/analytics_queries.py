"""Aggregations, evaluation and vector scalars."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.operators import evaluation as E
from gridloom.operators import pixels as P
from gridloom.plans.pixel_queries import CELL, rounded
from gridloom.registry import query
from gridloom.sources import tables as T


def both(spark, sf):
    return T.labels(spark, sf).join(T.labels(spark, sf, 0.3).withColumnRenamed("label", "predicted"), list(CELL))


@query("A1_label_counts", "SELECT label, count(*) AS n FROM labels_r GROUP BY label ORDER BY n, label")
def a1(spark, sf):
    return T.labels(spark, sf).groupBy("label").agg(F.count("*").alias("n")).orderBy("n", "label")


@query("A2_label_distribution", "SELECT d.label::INT AS label, count(l.label) AS n FROM (SELECT unnest(range(0, 10)) AS label) d LEFT JOIN labels_r l USING (label) GROUP BY d.label")
def a2(spark, sf):
    domain = spark.range(10).select(F.col("id").cast("int").alias("label"))
    return domain.join(T.labels(spark, sf).groupBy("label").agg(F.count("*").alias("k")), "label", "left").select("label", F.coalesce("k", F.lit(0)).cast("long").alias("n"))


@query("A3_inverse_frequency", "WITH c AS (SELECT label, count(*) AS n FROM labels_r GROUP BY label) SELECT label, round(sum(1 + n) OVER () / (1.0 + n), 6) AS weight FROM c")
def a3(spark, sf):
    c = T.labels(spark, sf).groupBy("label").agg(F.count("*").alias("n"))
    return c.select("label", F.round(F.sum(1 + F.col("n")).over(W.partitionBy()) / (1.0 + F.col("n")), 6).alias("weight"))


CONFUSION = "m AS (SELECT l.label AS truth, p.label AS predicted, count(*) AS n FROM labels_r l JOIN predicted_r p USING (image_id, r, c) WHERE l.label <> 0 GROUP BY ALL)"


@query("A4_confusion_hard", f"WITH {CONFUSION} SELECT truth, predicted, n FROM m")
def a4(spark, sf):
    return E.confusion(both(spark, sf))


SOFT = "s AS (SELECT image_id, r, c, label AS predicted, (p + 0.000025) / (sum(p) OVER (PARTITION BY image_id, r, c) + 0.0001) AS p FROM dist_u)"


@query("A5_confusion_soft", f"WITH {SOFT} SELECT l.label AS truth, predicted::INT AS predicted, round(sum(p), 4) AS weight FROM labels_r l JOIN s USING (image_id, r, c) GROUP BY ALL")
def a5(spark, sf):
    d = P.smoothed_distribution(T.unnormalised(spark, sf)).withColumnRenamed("label", "predicted")
    return T.labels(spark, sf).join(d, list(CELL)).groupBy(F.col("label").alias("truth"), "predicted").agg(F.round(F.sum("p"), 4).alias("weight"))


@query("A6_accuracy", f"WITH {CONFUSION}, r AS (SELECT truth, sum(n) AS total, sum(CASE WHEN truth = predicted THEN n ELSE 0 END) AS hit FROM m GROUP BY truth) SELECT round((SELECT sum(hit) / sum(total) FROM r), 6) AS overall, round(avg(hit / greatest(total, 1)), 6) AS average FROM r")
def a6(spark, sf):
    return rounded(E.accuracy(E.confusion(both(spark, sf))), "overall", "average")


@query("A7_matrix_add", f"WITH {CONFUSION}, t AS (SELECT truth, predicted, sum(n) AS n FROM (SELECT * FROM m UNION ALL SELECT predicted, truth, n FROM m) GROUP BY ALL) SELECT truth, predicted, n::BIGINT AS n, (sum(n) OVER (PARTITION BY truth))::BIGINT AS row_sum FROM t")
def a7(spark, sf):
    m = E.confusion(both(spark, sf))
    t = m.unionByName(m.select(F.col("predicted").alias("truth"), F.col("truth").alias("predicted"), "n")).groupBy("truth", "predicted").agg(F.sum("n").alias("n"))
    return t.withColumn("row_sum", F.sum("n").over(W.partitionBy("truth")))


CHANGES = "k AS (SELECT id, rank, positive, sum(positive::INT) OVER w AS tp, sum((NOT positive)::INT) OVER w AS fp FROM ranking WINDOW w AS (ORDER BY rank DESC, id ROWS UNBOUNDED PRECEDING)), t AS (SELECT *, max(tp) OVER () AS p, max(fp) OVER () AS n FROM k)"


@query("A8_ranking_changes", f"WITH {CHANGES} SELECT id, tp::BIGINT AS tp, fp::BIGINT AS fp, (n - fp)::BIGINT AS tn, (p - tp)::BIGINT AS fn FROM t")
def a8(spark, sf):
    return E.changes(T.ranking(spark, sf)).select("id", "tp", "fp", (F.col("n") - F.col("fp")).alias("tn"), (F.col("p") - F.col("tp")).alias("fn"))


@query("A9_precision_recall", f"WITH {CHANGES} SELECT id, round(tp / (tp + fp), 6) AS precision, round(tp / p, 6) AS recall FROM t WHERE positive")
def a9(spark, sf):
    return E.precision_recall(E.changes(T.ranking(spark, sf))).select("id", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("A9_average_precision", f"WITH {CHANGES} SELECT round(sum(tp / (tp + fp)) / max(p), 6) AS ap FROM t WHERE positive")
def a9ap(spark, sf):
    return E.average_precision(E.changes(T.ranking(spark, sf))).select(F.round("ap", 6).alias("ap"))


ROC = f"{CHANGES}, q AS (SELECT rank, id, tp / p AS tpr, fp / n AS fpr FROM t WHERE positive), g AS (SELECT *, lag(tpr, 1, 0) OVER o AS tpr0, lag(fpr, 1, 0) OVER o AS fpr0 FROM q WINDOW o AS (ORDER BY rank DESC, id))"


@query("A10_roc_auc", f"WITH {ROC} SELECT round(sum((fpr - fpr0) * (tpr + tpr0) / 2) + 1 - max(fpr), 6) AS auc FROM g")
def a10(spark, sf):
    return E.auc(E.changes(T.ranking(spark, sf))).select(F.round("auc", 6).alias("auc"))


@query("A11_rank_at_rates", f"WITH {CHANGES}, e AS (SELECT *, fp / n AS fpr, 1 - tp / p AS fnr FROM t), l AS (SELECT *, lag(rank) OVER (ORDER BY rank DESC, id) AS before FROM e) SELECT (SELECT max(rank) FROM e WHERE fpr >= 0.25) AS at_fpr, (SELECT (rank + before) / 2 FROM l WHERE fpr >= fnr ORDER BY rank DESC, id LIMIT 1) AS at_eer")
def a11(spark, sf):
    return E.ranks_at(E.changes(T.ranking(spark, sf)), 0.25)


@query("A12_histogram", "WITH b AS (SELECT min(v) AS lo, (max(v) - min(v)) / 10 AS w FROM raster) SELECT floor((v - lo) / w)::BIGINT AS bin, count(*) AS n FROM raster, b WHERE v < lo + 10 * w GROUP BY bin")
def a12(spark, sf):
    """Equal widths; the greatest value can fall outside the last bin."""
    df = T.raster(spark, sf)
    b = df.agg(F.min("v").alias("lo"), ((F.max("v") - F.min("v")) / 10).alias("w"))
    return df.join(F.broadcast(b)).filter("v < lo + 10 * w").groupBy(F.floor((F.col("v") - F.col("lo")) / F.col("w")).alias("bin")).agg(F.count("*").alias("n"))  # b is one row


@query("A13_entropy", "WITH c AS (SELECT image_id, label, count(*) AS n FROM labels_r GROUP BY ALL), p AS (SELECT image_id, n / sum(n) OVER (PARTITION BY image_id) AS p FROM c) SELECT image_id, round(-sum(p * log2(p)), 6) + 0.0 AS entropy FROM p GROUP BY image_id")
def a13(spark, sf):
    c = T.labels(spark, sf).groupBy("image_id", "label").count()
    p = c.withColumn("p", F.col("count") / F.sum("count").over(W.partitionBy("image_id")))
    return p.groupBy("image_id").agg((F.round(-F.sum(F.col("p") * F.log2("p")), 6) + 0.0).alias("entropy"))


@query("A14_smoothed_entropy", f"WITH {SOFT} SELECT image_id, r, c, round(-sum((p + 0.0001) * log2(p + 0.0001)), 5) + 0.0 AS entropy FROM s GROUP BY ALL")
def a14(spark, sf):
    d = P.smoothed_distribution(T.unnormalised(spark, sf)).withColumn("q", F.col("p") + 1e-4)
    return d.groupBy(*CELL).agg((F.round(-F.sum(F.col("q") * F.log2("q")), 5) + 0.0).alias("entropy"))


@query("A15_product", "SELECT image_id, r, round(product(1 + v), 6) AS v FROM raster GROUP BY ALL")
def a15(spark, sf):
    return T.raster(spark, sf).groupBy("image_id", "r").agg(F.round(F.product(1 + F.col("v")), 6).alias("v"))


@query("A16_argmax_argmin", "SELECT image_id, arg_max(r * 8 + c, {'v': v, 'k': -(r * 8 + c)})::INT AS most, arg_min(r * 8 + c, {'v': v, 'k': r * 8 + c})::INT AS least FROM raster GROUP BY image_id")
def a16(spark, sf):
    k = F.col("r") * 8 + F.col("c")
    return T.raster(spark, sf).groupBy("image_id").agg(F.max_by(k, F.struct("v", (-k).alias("k"))).alias("most"), F.min_by(k, F.struct("v", k.alias("k"))).alias("least"))


@query("A17_gaussian_fit", "SELECT image_id, round(avg(v), 6) AS mean, round(var_samp(v), 6) AS variance FROM raster GROUP BY image_id")
def a17(spark, sf):
    return T.raster(spark, sf).groupBy("image_id").agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.var_samp("v"), 6).alias("variance"))


PDF = "exp(-v * v / (2 * 0.01)) / (0.1 * sqrt(2 * pi()))"


@query("A18_gaussian_pdf", f"SELECT image_id, r, c, round({PDF}, 6) AS pdf, round(-v / 0.01 * {PDF}, 5) + 0.0 AS first, round((v * v / 0.0001 - 100) * {PDF}, 4) + 0.0 AS second FROM raster")
def a18(spark, sf):
    v = F.col("v")
    pdf = F.exp(-v * v / (2 * 0.01)) / (0.1 * math.sqrt(2 * math.pi))
    return T.raster(spark, sf).select(*CELL, F.round(pdf, 6).alias("pdf"), (F.round(-v / 0.01 * pdf, 5) + 0.0).alias("first"), (F.round((v * v / 0.0001 - 100) * pdf, 4) + 0.0).alias("second"))


@query("A18_gaussian_2d", "WITH m AS (SELECT image_id, avg(r) AS mr, avg(c) AS mc, sum(abs(v) * r) / sum(abs(v)) AS wr, covar_samp(v, r) AS vr, var_samp(v) AS vv, var_samp(r) AS rr FROM raster GROUP BY image_id) SELECT image_id, round(exp(-0.5 * (rr * 0.01 - 2 * vr * 0.1 * 0.5 + vv * 0.25) / (vv * rr - vr * vr)) / (2 * pi() * sqrt(vv * rr - vr * vr)), 6) AS pdf FROM m")
def a18n(spark, sf):
    """The density of (v, r), fitted with covariance, at 0.1 and 0.5 from the mean: the inverse in closed form."""
    m = T.raster(spark, sf).groupBy("image_id").agg(F.covar_samp("v", "r").alias("vr"), F.var_samp("v").alias("vv"), F.var_samp("r").alias("rr"))
    det = F.col("vv") * F.col("rr") - F.col("vr") * F.col("vr")
    q = (F.col("rr") * 0.01 - 2 * F.col("vr") * 0.1 * 0.5 + F.col("vv") * 0.25) / det
    return m.select("image_id", F.round(F.exp(-0.5 * q) / (2 * math.pi * F.sqrt(det)), 6).alias("pdf"))


@query("A19_gamma_fit")
def a19(spark, sf):
    """Shape by the standard closed approximation from the log mean, scale, and the density at the mean."""
    m = T.raster(spark, sf).withColumn("x", F.abs("v") + 1e-6).groupBy("image_id").agg(F.avg("x").alias("mean"), F.avg(F.ln("x")).alias("log_mean"))
    s = F.ln("mean") - F.col("log_mean")
    m = m.withColumn("shape", (3 - s + F.sqrt((s - 3) * (s - 3) + 24 * s)) / (12 * s)).withColumn("scale", F.col("mean") / F.col("shape"))

    @F.pandas_udf("double")
    def lgamma(x: pd.Series) -> pd.Series:
        return x.map(math.lgamma)

    log_pdf = (F.col("shape") - 1) * F.ln("mean") - F.col("mean") / F.col("scale") - F.col("shape") * F.ln("scale") - lgamma("shape")
    return m.select("image_id", "shape", "scale", F.exp(log_pdf).alias("pdf_at_mean"))


@query("A20_weighted_pick", "WITH u AS (SELECT image_id, ((image_id * 2654435761) % 1000003) / 1000003.0 AS u FROM raster WHERE r = 0 AND c = 0), w AS (SELECT image_id, r * 8 + c AS k, sum(round(abs(v), 6)::DECIMAL(12, 6)) OVER (PARTITION BY image_id ORDER BY r * 8 + c) AS upto, sum(round(abs(v), 6)::DECIMAL(12, 6)) OVER (PARTITION BY image_id) AS total FROM raster) SELECT image_id, min(k)::INT AS cell FROM w JOIN u USING (image_id) WHERE upto::DOUBLE > u * total::DOUBLE GROUP BY image_id")
def a20(spark, sf):
    """A cell of each image drawn by weight: the first whose running weight passes a hashed share of all."""
    d = T.raster(spark, sf).select("image_id", (F.col("r") * 8 + F.col("c")).alias("k"), F.round(F.abs("v"), 6).cast("decimal(12,6)").alias("w"))
    over = W.partitionBy("image_id")
    u = ((F.col("image_id") * 2654435761) % 1000003) / 1000003.0
    d = d.withColumn("upto", F.sum("w").over(over.orderBy("k")).cast("double")).withColumn("total", F.sum("w").over(over).cast("double"))
    return d.filter(F.col("upto") > u * F.col("total")).groupBy("image_id").agg(F.min("k").alias("cell"))


@query("A21_bounds", "SELECT min(s_acctbal) AS x0, max(s_acctbal) AS x1, min(s_nationkey) AS y0, max(s_nationkey) AS y1 FROM supplier")
def a21(spark, sf):
    return T.table(spark, sf, "supplier").agg(F.min("s_acctbal").alias("x0"), F.max("s_acctbal").alias("x1"), F.min("s_nationkey").alias("y0"), F.max("s_nationkey").alias("y1"))


@query("A22_rank_pairs", "SELECT id, rank FROM ranking ORDER BY rank DESC, id")
def a22(spark, sf):
    return T.ranking(spark, sf).orderBy(F.desc("rank"), "id").select("id", "rank")


LEAVES = "leaf AS (SELECT id, label, 4 + (CASE WHEN data[1] < 0 THEN 0 ELSE 2 END) + (CASE WHEN data[2] < 0 THEN 0 ELSE 1 END) AS idx FROM points)"


def leaves(spark, sf):
    """Heap places of points in a fixed tree of two levels (1 is the root)."""
    d = F.col("data")
    return T.points(spark, sf).select("id", "label", (F.lit(4) + F.when(d[0] < 0, 0).otherwise(2) + F.when(d[1] < 0, 0).otherwise(1)).alias("idx"))


@query("A23_node_statistics", f"WITH {LEAVES}, a AS (SELECT id, label, idx >> k AS node FROM leaf, (SELECT unnest([0, 1, 2]) AS k)), c AS (SELECT node, label, count(*) AS n FROM a GROUP BY ALL), p AS (SELECT node, n, n / sum(n) OVER (PARTITION BY node) AS p FROM c) SELECT node::INT AS node, sum(n)::BIGINT AS points, round(-sum(p * log2(p)), 6) + 0.0 AS entropy FROM p GROUP BY node")
def a23(spark, sf):
    c = E.ancestors(leaves(spark, sf), 2).groupBy("node", "label").count()
    p = c.withColumn("p", F.col("count") / F.sum("count").over(W.partitionBy("node")))
    return p.groupBy("node").agg(F.sum("count").alias("points"), (F.round(-F.sum(F.col("p") * F.log2("p")), 6) + 0.0).alias("entropy"))


@query("A24_forest_histogram", f"WITH {LEAVES}, a AS (SELECT id, label, idx >> k AS node FROM leaf, (SELECT unnest([0, 1, 2]) AS k)) SELECT label, node::INT AS node, round(count(*) / (SELECT count(*) FROM points q WHERE q.label = a.label), 6) AS value FROM a GROUP BY label, node")
def a24(spark, sf):
    a = E.ancestors(leaves(spark, sf), 2).groupBy("label", "node").count()
    n = F.max(F.when(F.col("node") == 1, F.col("count"))).over(W.partitionBy("label"))
    return a.select("label", "node", F.round(F.col("count") / n, 6).alias("value"))


def dot(f):
    return f"(SELECT list_sum(list_transform(list_zip(a.data, b.data), lambda x: {f})))"


@query("V1_vector_arithmetic", "SELECT id, round(list_sum(list_transform(data, lambda x: x::DOUBLE + 2.0 * x::DOUBLE)), 5) + 0.0 AS total FROM points")
def v1(spark, sf):
    t = F.zip_with("data", F.transform("data", lambda x: x * 2.0), lambda a, b: a + b)
    return T.points(spark, sf).select("id", (F.round(F.aggregate(t, F.lit(0.0), lambda acc, x: acc + x), 5) + 0.0).alias("total"))


def squared(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x)


@query("V2_squared_distance", "SELECT a.id, round(list_sum([(x[1]::DOUBLE - x[2]::DOUBLE) ** 2 for x in list_zip(a.data, b.data)]), 5) AS d FROM points a JOIN points b ON b.id = a.id + 1")
def v2(spark, sf):
    p = T.points(spark, sf)
    q = p.select((F.col("id") - 1).alias("id"), F.col("data").alias("other"))
    return p.join(q, "id").select("id", F.round(squared("data", "other"), 5).alias("d"))


@query("V3_display_string", "SELECT image_id, string_agg(label::VARCHAR, ',' ORDER BY r, c) AS shown FROM labels_r GROUP BY image_id")
def v3(spark, sf):
    s = F.transform(F.array_sort(F.collect_list(F.struct("r", "c", "label"))), lambda x: x["label"].cast("string"))
    return T.labels(spark, sf).groupBy("image_id").agg(F.concat_ws(",", s).alias("shown"))


@query("V4_integer_scalars", "SELECT event_id, floor(log2(event_id + 1))::BIGINT AS lg, greatest(least(event_id, 500), 100) AS cut, (1 << (event_id % 10)::INT)::BIGINT AS pow2 FROM events")
def v4(spark, sf):
    e = F.col("event_id")
    lg = F.length(F.bin(e + 1)).cast("long") - 1
    return T.table(spark, sf, "events").select("event_id", lg.alias("lg"), F.greatest(F.least(e, F.lit(500)), F.lit(100)).alias("cut"), F.pow(F.lit(2), e % 10).cast("long").alias("pow2"))


@query("V5_label_set_names", "SELECT image_id, string_agg('label' || label, ' ' ORDER BY label) AS names FROM (SELECT DISTINCT image_id, label FROM labels_r) GROUP BY image_id")
def v5(spark, sf):
    return T.labels(spark, sf).groupBy("image_id").agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_set("label")), lambda x: F.concat(F.lit("label"), x.cast("string")))).alias("names"))
