"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm.common import release, staged, text_of
from gridloom.llm.repeats import NULL_ID

#: A paragraph cell: a line, cut after 160 characters; the first line of a text also after 12, 36 and
#: 84, so that short texts have some cells too.
CELL = r"\A[^\n]{1,12}|(?<=\A[^\n]{12})[^\n]{1,24}|(?<=\A[^\n]{36})[^\n]{1,48}|[^\n]{1,160}"
#: Rounds of peeling; a few are enough for wide sketches, and what is left over is retried at a larger size.
ROUNDS, FEW = 8, 4
#: Digests of a partition in which sketches are made and peeled.
DEALT = 100_000
#: Of the hash functions of all sketches that are written and subtracted.
SALT = 0


def digests(text: Column) -> Column:
    """The distinct 64-bit digests of the paragraph cells of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(CELL), F.lit(0)), lambda p: F.xxhash64(p)))


def check(digest: Column) -> Column:
    return F.xxhash64(F.lit(99), digest)


def places(digest: Column, size: Column, salt: int) -> list[Column]:
    """The three cells of a digest in a sketch of ``size`` cells, one in each third."""
    third = F.floor(size / 3)
    return [F.pmod(F.xxhash64(F.lit(salt * 10 + i), digest), third) + F.lit(i) * third for i in range(3)]


def cells_of(n: Column) -> Column:
    """Cells of the sketch of ``n`` digests: three times a power of two, more than 16 n + 150.

    Only cells that aren't empty are kept and written, at most three a digest, so a wide sketch is no longer
    than a narrow one, peels in few rounds, and two digests share all their cells once in 10**5 texts.
    """
    return (F.pow(F.lit(2.0), F.length(F.bin(F.floor((n * 16 + 150) / 3)))) * 3).cast("long")


def written(rows: DataFrame) -> DataFrame:
    """Sketches as text, in hexadecimal digits: the number of cells, then count, digest sum and check sum of each cell that isn't empty.

    ``rows`` (rid, own, other) is partitioned by rid, so no row moves. Returns rid, fingerprint, edited_fingerprint. Texts without digests have none.
    """
    side = lambda k, name: F.struct(F.lit(k).alias("side"), F.col(name).alias("a"), cells_of(F.size(name)).alias("size"))
    sides = rows.select("rid", F.explode(F.array(side(0, "own"), side(1, "other"))).alias("s")).select("rid", "s.*")
    entries = sides.select("rid", "side", "size", F.explode("a").alias("d"))
    cells = entries.select("rid", "side", "size", "d", F.explode(F.array(*places(F.col("d"), F.col("size"), SALT))).alias("cell"))
    cells = cells.groupBy("rid", "side", "size", "cell").agg(F.count("*").alias("n"), F.bit_xor("d").alias("sum"), F.bit_xor(check(F.col("d"))).alias("chk"))
    text = F.concat_ws(".", F.hex("cell"), F.hex("n"), F.hex("sum"), F.hex("chk"))
    prints = cells.groupBy("rid", "side", "size").agg(F.array_sort(F.collect_list(F.struct("cell", text.alias("text")))).alias("cells"))
    whole = F.concat(F.hex("size"), F.lit(":"), F.array_join(F.transform("cells", lambda c: c["text"]), "-"))
    of = lambda k: F.max(F.when(F.col("side") == k, whole))
    return prints.groupBy("rid").agg(of(0).alias("fingerprint"), of(1).alias("edited_fingerprint"))


def peeled(pairs: DataFrame, factor: float, more: int, salt: int, rounds: int = ROUNDS, size: str | None = None, by: tuple[str, ...] = ("r", "th", "v")) -> DataFrame:
    """Subtract the sketches of both sides of each pair and peel what is left.

    ``pairs`` (the columns ``by``, kind, a, b) is partitioned by some of ``by``, so all of this stays in a task. In a
    round, each cell that holds a single digest gives it up, once for all its cells, and the digest is
    taken out of its three cells. Cells that have become empty drop out of the table. ``size`` names a
    column with the number of cells, in place of ``factor`` and ``more``.

    Returns ``by``, kind, size, differing (digests given out), gone and new (those of a and of b alone), whole (nothing was left).
    """
    key = [*by, "kind"]
    size = F.col(size).alias("size") if size else (F.floor((F.size("a") + F.size("b")) * factor / 3).cast("long") * 3 + more).alias("size")
    side = lambda name, sign: F.transform(F.col(name), lambda d: F.struct(d.alias("d"), F.lit(sign).cast("long").alias("n")))
    entry = F.explode(F.concat(F.array(F.struct(F.lit(None).cast("long").alias("d"), F.lit(0).cast("long").alias("n"))), side("a", 1), side("b", -1)))
    rows = pairs.select(*key, size, entry.alias("e")).select(*key, "size", "e.d", "e.n")
    zero, none = F.lit(0).cast("long"), F.lit(-1).cast("long")
    cells = F.when(F.col("d").isNull(), F.array(none)).otherwise(F.array(*places(F.col("d"), F.col("size"), salt)))
    # cell -1 keeps what has been recovered, each digest as got
    rows = rows.select(*key, "size", F.explode(cells).alias("cell"), F.lit(None).cast("long").alias("got"), "n", F.coalesce("d", zero).alias("d"), F.when(F.col("d").isNull(), zero).otherwise(check(F.col("d"))).alias("chk"))

    def summed(rows: DataFrame) -> DataFrame:
        out = rows.groupBy(*key, "cell", "got").agg(F.max("size").alias("size"), F.sum("n").alias("n"), F.bit_xor("d").alias("d"), F.bit_xor("chk").alias("chk"))
        return out.filter("cell = -1 or n != 0 or d != 0 or chk != 0")

    state = summed(rows)
    for _ in range(rounds):
        pure = (F.col("cell") >= 0) & (F.abs("n") == 1) & (F.col("chk") == check(F.col("d")))
        both = state.withColumn("out", F.explode(F.when(pure, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
        tag = F.when(F.col("out"), F.col("d")).otherwise(F.col("cell")).alias("tag")
        once = both.select(*key, "out", tag, "got", "size", "n", "d", "chk").groupBy(*key, "out", "tag", "got").agg(*[F.max(c).alias(c) for c in ("size", "n", "d", "chk")])
        item = lambda cell, got, n, d, chk: F.struct(cell.alias("cell"), got.alias("got"), n.alias("n"), d.alias("d"), chk.alias("chk"))
        taken = [item(p, F.col("got"), -F.col("n"), F.col("d"), F.col("chk")) for p in places(F.col("d"), F.col("size"), salt)]
        moves = F.when(F.col("out"), F.array(*taken, item(none, F.col("d"), F.col("n"), zero, zero))).otherwise(F.array(item(F.col("tag"), F.col("got"), F.col("n"), F.col("d"), F.col("chk"))))
        state = summed(once.select(*key, "size", F.explode(moves).alias("m")).select(*key, "size", "m.cell", "m.got", "m.n", "m.d", "m.chk"))
    held = lambda sign: F.collect_list(F.when(F.col("n") * sign > 0, F.col("got")))
    return state.groupBy(*key).agg(F.max("size").alias("size"), F.count("got").alias("differing"), held(1).alias("gone"), held(-1).alias("new"), (F.max("cell") == -1).alias("whole"))


def subtracted(sets: DataFrame, dealt: int = 8, by: tuple[str, ...] = ("r", "th", "v")) -> DataFrame:
    """What differs between own and other and between own and next (digest arrays of the rows ``by``), by their sketches.

    Two sketches are subtracted at the size of the larger, the text of the smaller one being sketched anew for
    that. The size is decided by the digests, so a text has one sketch wherever it is met. A pair that
    can't be peeled at this size is sketched anew at doubled sizes until it can, so nothing is left out.

    Returns ``by``, gone0, new0 of own and other, gone1, new1 of own and next.
    """
    names = ("own", "other", "next")
    state = sets.select(*by, *names, *[F.greatest(cells_of(F.size("own")), cells_of(F.size(n))).alias(f"p{i}") for i, n in enumerate(names[1:])])
    done, k = None, 0
    while True:
        parts = [F.struct(F.lit(i).alias("kind"), F.col("own").alias("a"), F.col(n).alias("b"), F.col(f"p{i}").alias("cells")) for i, n in enumerate(names[1:])]
        pairs = state.repartition(dealt, by[0]).select(*by, F.explode(F.array(*parts)).alias("p")).select(*by, "p.*")
        at = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
        found = peeled(pairs, 0, 0, SALT, rounds=FEW, size="cells", by=by).groupBy(*by).agg(*[at(i, c).alias(f"{c}{i}") for i in (0, 1) for c in ("size", "whole", "gone", "new")])
        found = staged(found, f"fingerprint-subtracted{k}")
        ready = F.col("whole0") & F.col("whole1")
        good = found.filter(ready).select(*by, "gone0", "new0", "gone1", "new1")
        done, k = good if done is None else done.unionByName(good), k + 1
        again = found.filter(~ready)
        if again.isEmpty():
            return done
        sizes = again.select(*by, *[F.when(F.col(f"whole{i}"), F.col(f"size{i}")).otherwise(F.col(f"size{i}") * 2).alias(f"p{i}") for i in (0, 1)])
        state = sets.select(*by, *names).join(sizes, list(by))


#: Ranges of identifiers, by quantiles, that documents are dealt to; each is cut further from so many documents on.
RANGES, LARGE = 1024, 2_000_000


def ranged(rows: DataFrame) -> tuple[DataFrame, list[str], bool]:
    """Deal rows (r, th, text) to buckets that follow each other in the order of r; returns the rows, the bucket's columns, and whether any row stands for several.

    Ranges of r come from quantiles, so far-off values don't matter. A value of r that itself has more rows than
    a range is cut by the hash of the text, and rows repeated that often (equal r and text) are counted before they move and become one row with
    the number of its ``times``, so that no identifier, and no repeated row, is one task. All is decided by the rows' values, so reading them again gives the same.
    """
    keys = staged(rows.groupBy("r", "th").agg(F.count("*").alias("copies")), "fingerprint-keys")
    total = keys.agg(F.sum("copies")).first()[0] or 0
    k = max(1, min(RANGES, total // 250))
    many = total / k
    heavy = staged(keys.groupBy("r").agg(F.sum("copies").alias("copies")).filter(F.col("copies") > many).select(F.col("r").alias("r_many")), "fingerprint-heavy")
    repeated = staged(keys.filter(F.col("copies") > many).select(F.col("r").alias("r_same"), F.col("th").alias("th_same")), "fingerprint-repeated")
    found = keys.agg(F.percentile_approx("r", F.lit([i / k for i in range(1, k)]), F.lit(10 * RANGES))).first()[0] if k > 1 and total else []
    cuts = sorted({*(found or []), *(r["r_many"] for r in heavy.collect())})  # a heavy value's rows begin a range
    step = 32
    coarse = cuts[step - 1 :: step]
    below = lambda values: F.size(F.filter(values, lambda x: x <= F.col("r")))
    longs = lambda values: F.lit(values) if values else F.array().cast("array<bigint>")
    rows = rows.withColumn("q0", below(longs(coarse)) * step)
    rows = rows.withColumn("q", F.col("q0") + below(F.slice(longs(cuts), F.col("q0") + 1, F.lit(step)))).drop("q0")
    # ranges are cut evenly where they have many rows
    fine = max(1, total // k // LARGE)
    lo, hi = (F.get(longs(cuts), F.col("q") - i).cast("double") for i in (1, 0))
    rows = rows.withColumn("s", F.coalesce(F.floor((F.col("r").cast("double") - lo) / (hi - lo) * fine), F.lit(0)).cast("long") if fine > 1 else F.lit(0).cast("long"))
    # both tables have fewer rows than there are ranges
    rows = rows.join(F.broadcast(heavy), F.col("r") == F.col("r_many"), "left").join(F.broadcast(repeated), (F.col("r") == F.col("r_same")) & (F.col("th") == F.col("th_same")), "left")
    part = F.when(F.col("th_same").isNotNull(), F.col("th")).when(F.col("r_many").isNotNull(), F.shiftleft(F.shiftright("th", 56), 56)).otherwise(F.lit(0).cast("long"))
    bucket = ["q", "s", "rest", "part"]
    rows = rows.withColumn("rest", F.col("r_many").isNull()).withColumn("part", part)
    one = F.lit(1).cast("long").alias("times")
    if repeated.isEmpty():
        return rows.select(*bucket, "r", "th", "text", one), bucket, False
    counted = rows.filter("th_same is not null").groupBy(*bucket, "r", "th", "text").agg(F.count("*").alias("times"))
    return rows.filter("th_same is null").select(*bucket, "r", "th", "text", one).unionByName(counted), bucket, True


def repeated_out(rows: DataFrame, block: int = 65536) -> DataFrame:
    """Each row ``times`` times, dealt out in blocks so that many copies don't come from one task."""
    blocks = rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(times - 1) div {block}"))))
    here = F.least(F.lit(block), F.col("times") - F.col("block") * block).cast("int")
    return blocks.repartition("rid", "block").withColumn("copy", F.explode(F.sequence(F.lit(1), here))).drop("block", "copy", "times")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint every text and its edited text, and tell their likeness by what differs.

    The edited text is the text with its last floor(n_chars / 3) code points replaced by as many
    from the start of the next document (all of it if it is shorter), by descending identifier; the next of the
    last is the first. A fingerprint is an invertible Bloom lookup sketch of the digests of
    the paragraph cells of a text, of a size that grows with their number. Likeness
    is the Jaccard similarity of two sets of digests: the fingerprints are subtracted and peeled, which recovers the digests that
    differ, at larger sizes where the first isn't enough. Texts move once, to ranges of identifiers in which each meets the next;
    sketching and peeling happen in the partition of the row.

    Null texts are empty (an empty fingerprint; like each other); null ids come last; rows with equal
    id come in an order decided by their texts' hashes, repeated rows one after the other; a single row is its own next.
    An empty table gives no rows; texts of any length go through whole; other columns are not read; ids are whole numbers.

    Returns id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and the
    recovered digests: edited_gone and edited_new (those that the text and the edited text have alone), next_gone and next_new.
    """
    spark = docs.sparkSession
    text = text_of(text_col)
    # r: the identifier's complement, in whose ascending order the next document follows
    rows = docs.select(F.bitwise_not(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))).alias("r"), F.xxhash64(text).alias("th"), text.alias("text"))
    rows, bucket, several = ranged(rows)
    me = F.struct("r", "th")
    firsts = rows.groupBy(*bucket).agg(F.min(me).alias("first"))
    over = W.orderBy(*bucket)  # a row for each bucket
    firsts = staged(firsts.select(*bucket, F.coalesce(F.lead("first").over(over), F.first("first").over(over)).alias("key")), "fingerprint-ranges")
    # what follows the last row of each bucket: the first of the next one
    starts = rows.withColumn("key", me).join(firsts.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.first("text").alias("beyond"))
    starts = firsts.join(starts, "key").drop("key")
    within = W.partitionBy(*bucket).orderBy("r", "th")
    n = F.char_length("text")
    met = rows.withColumn("own", digests(F.col("text"))).withColumn("after", F.lead("text").over(within)).withColumn("next", F.lead("own").over(within)).join(starts, bucket)
    if several:
        # of a row that stands for several, the last is followed by the next row, and each of the others by its like
        like = F.explode(F.when(F.col("times") > 1, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False))))
        met = met.withColumn("like", like).withColumn("times", F.when(F.col("like"), F.col("times") - 1).otherwise(1))
        met = met.withColumn("after", F.when(F.col("like"), F.col("text")).otherwise(F.col("after"))).withColumn("next", F.when(F.col("like"), F.col("own")).otherwise(F.col("next")))
    met = met.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - F.floor(n / 3).cast("int")), F.substring(F.coalesce("after", "beyond"), F.lit(1), F.floor(n / 3).cast("int"))))
    sets = met.select(
        F.monotonically_increasing_id().alias("rid"), F.when(F.bitwise_not("r") != NULL_ID, F.bitwise_not("r")).alias("id"), n.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "times",
        "own", digests(F.col("edited")).alias("other"), F.coalesce("next", digests(F.col("beyond"))).alias("next"),
    )
    sets = staged(sets, "fingerprint-sets")
    release(spark)

    held = sets.agg(F.sum(F.size("own") + F.size("other") + F.size("next")).cast("long")).first()[0] or 0
    dealt = max(spark.sparkContext.defaultParallelism, held // DEALT + 1)
    found = subtracted(sets, dealt, ("rid",))
    by_row = lambda df: df.repartition(dealt, "rid")
    prints = written(by_row(sets.select("rid", "own", "other")))
    counts = by_row(sets.select("rid", "id", "n_chars", "edited_sha256", "times", *[F.size(c).alias(c) for c in ("own", "other", "next")]))
    out = counts.join(by_row(found), "rid").join(prints, "rid", "left")
    out = repeated_out(out) if several else out.drop("times")

    def near(other: str, k: int) -> Column:
        total = F.col("own") + F.col(other)
        same = (total - F.size(f"gone{k}") - F.size(f"new{k}")) / 2
        return F.when(total == 0, F.lit(1.0)).otherwise(F.least(F.greatest(same / (total - same), F.lit(0.0)), F.lit(1.0)))

    return out.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", F.coalesce("fingerprint", F.lit("")).alias("fingerprint"), F.coalesce("edited_fingerprint", F.lit("")).alias("edited_fingerprint"),
        near("other", 0).alias("near_edited"), near("next", 1).alias("near_next"),
        F.col("gone0").alias("edited_gone"), F.col("new0").alias("edited_new"), F.col("gone1").alias("next_gone"), F.col("new1").alias("next_new"),
    )


def op9_fingerprints(spark, sf_dir):
    """All documents' fingerprints with their likeness; see ``fingerprints``."""
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
