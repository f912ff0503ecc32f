"""Confusion matrices and evaluation of rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions.literals import doubles, integers

PARTS = 256


def confusion(df: DataFrame, background: int = 0) -> DataFrame:
    """Counts of (truth, predicted), cells of background truth left out."""
    return df.filter(F.col("label") != background).groupBy(F.col("label").alias("truth"), "predicted").agg(F.count("*").alias("n"))


def accuracy(m: DataFrame) -> DataFrame:
    hit = F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0))
    rows = m.groupBy("truth").agg(F.sum("n").alias("total"), hit.alias("hit"))
    return rows.agg((F.sum("hit") / F.sum("total")).alias("overall"), F.avg(F.col("hit") / F.greatest("total", F.lit(1))).alias("average"))


def ranges(rows: DataFrame, value: str, parts: int = PARTS) -> DataFrame:
    """``rows`` with ``part``: ranges of about equal numbers of rows by falling ``value``, from approximate quantiles.

    Equal values share a range. The cuts, fewer than ``parts`` numbers, are searched by halving.
    """
    cuts = rows.agg(F.percentile_approx(value, [i / parts for i in range(1, parts)], 10 * parts)).first()[0]
    cuts = sorted({float(x) for x in cuts or []})
    size = 1 << len(cuts).bit_length()
    padded = doubles([*cuts, *[float("inf")] * (size - len(cuts))])
    steps = integers(size >> k for k in range(1, size.bit_length())) if size > 1 else F.expr("array(0)")
    below = F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get(padded, at + step - 1) <= F.col(value), step).otherwise(0))
    return rows.withColumn("part", -below)


def changes(ranking: DataFrame) -> DataFrame:
    """Running true and false positives in order of falling rank (then id), with the totals p and n.

    Ranks are dealt to ranges of about equal numbers of rows first; running sums of the ranges' totals and running sums within each add up, so no task holds
    all rows, however the ranks are spread. Rows without a rank or a truth are left out.
    """
    rows = ranges(ranking.filter("rank is not null and not isnan(rank) and positive is not null"), "rank")
    tp, fp = F.col("positive").cast("long"), (~F.col("positive")).cast("long")
    sums = rows.groupBy("part").agg(F.sum(tp).alias("t"), F.sum(fp).alias("f"))  # at most PARTS rows
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    sums = sums.select("part", F.coalesce(F.sum("t").over(before), zero).alias("t0"), F.coalesce(F.sum("f").over(before), zero).alias("f0"), F.sum("t").over(W.partitionBy()).alias("p"), F.sum("f").over(W.partitionBy()).alias("n"))
    w = W.partitionBy("part").orderBy(F.desc("rank"), "id").rowsBetween(W.unboundedPreceding, 0)
    own = rows.withColumn("t1", F.sum(tp).over(w)).withColumn("f1", F.sum(fp).over(w))
    return own.join(sums, "part").select("id", "rank", "positive", (F.col("t0") + F.col("t1")).alias("tp"), (F.col("f0") + F.col("f1")).alias("fp"), "p", "n")


def precision_recall(c: DataFrame) -> DataFrame:
    return c.filter("positive").select("id", "rank", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), (F.col("tp") / F.col("p")).alias("recall"))


def average_precision(c: DataFrame) -> DataFrame:
    """Mean precision at the positives; 0 without any."""
    return precision_recall(c).agg(F.coalesce(F.avg("precision"), F.lit(0.0)).alias("ap"))


def auc(c: DataFrame) -> DataFrame:
    """Area under the curve through the points at which true positives increase: trapezoids, then the rest at 1.

    A positive's predecessor has one true positive less and as many false ones as the positive before; the
    sum telescopes into sums over rows, so no ordering of all rows is needed.
    """
    good = c.filter("positive").select("tp", "fp", "p", "n")
    before = good.select((F.col("tp") + 1).alias("tp"), F.col("fp").alias("fp0"))
    step = good.join(before, "tp", "left").withColumn("fp0", F.coalesce("fp0", F.lit(0)))
    area = F.sum(F.try_divide(F.col("fp") - F.col("fp0"), F.col("n")) * (2 * F.col("tp") - 1) / F.col("p") / 2)
    return step.agg((area + 1 - F.max(F.try_divide("fp", "n"))).alias("auc"))


def ranks_at(c: DataFrame, fpr: float) -> DataFrame:
    """The rank at which the false positive rate reaches ``fpr``, and the midpoint of the two ranks around equal error."""
    rates = c.withColumn("fpr", F.try_divide("fp", "n")).withColumn("fnr", 1 - F.try_divide("tp", "p"))
    crossed = F.col("fpr") >= F.col("fnr")
    first = F.max(F.when(crossed, F.struct("rank", (-F.col("id")).alias("k"))))["rank"]
    last = F.min(F.when(~crossed, F.struct("rank", (-F.col("id")).alias("k"))))["rank"]
    return rates.agg(F.max(F.when(F.col("fpr") >= fpr, F.col("rank"))).alias("at_fpr"), ((first + last) / 2).alias("at_eer"))


def ancestors(leaf: DataFrame, depth: int) -> DataFrame:
    """Each leaf visit once for every node on its path, by heap places."""
    return leaf.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(depth)))).withColumn("node", F.expr("shiftright(idx, k)")).drop("k")
