"""Mixing sources to target weights. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm.common import BUCKETS, fraction, kept_rows, running, staged, text_of, word_count

ROUNDS = 24
#: Slots that one row of the slot generator makes.
CHUNK = 4096


def permuted(x: Column, n: Column, key: list[Column], inverse: bool = False, rounds: int = ROUNDS) -> Column:
    """x under a pseudorandom permutation of 0 .. n-1 decided by ``key`` (a swap-or-not shuffle).

    A round pairs x with (k - x) mod n and swaps the pair if a hash bit of the larger says so. A
    round is its own inverse, so the rounds in reverse order undo the permutation.
    """

    def step(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(F.lit(101), *key, r), n) - x, n)
        return F.when(F.xxhash64(F.lit(102), *key, r, F.greatest(x, other)).bitwiseAND(1) == 1, other).otherwise(x)

    order = F.sequence(F.lit(rounds - 1), F.lit(0)) if inverse else F.sequence(F.lit(0), F.lit(rounds - 1))
    return F.aggregate(order, x.cast("long"), step)


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, repeat: int = 2) -> DataFrame:
    """Per source: ``source_size``, ``target``. Sources by code point, null last, take the weights in turn.

    Together the targets are ``share`` of all sizes. A target above ``repeat`` times its source's
    size stops there, and the excess goes to the others by weight until none is above; the end of
    that is one water level for weight, found here from running sums over the sources.
    """
    one = W.orderBy(F.col("source").asc_nulls_last())
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("src", F.row_number().over(one).cast("long") - 1)
    s = s.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("src") % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * float(repeat))
    every, order = W.partitionBy(), W.orderBy(F.col("cap") / F.col("w"), "src").rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumn("total", F.sum("source_size").over(every) * share).withColumn("all_w", F.sum("w").over(every))
    s = s.withColumn("level", F.try_divide(F.col("total") - F.coalesce(F.sum("cap").over(order), F.lit(0.0)), F.col("all_w") - F.coalesce(F.sum("w").over(order), F.lit(0.0))))
    s = s.withColumn("level", F.min(F.when(F.col("level") * F.col("w") <= F.col("cap") * (1 + 1e-12), F.struct((F.col("cap") / F.col("w")).alias("r"), "src", "level"))).over(every)["level"])
    return s.select("source", "src", "source_size", F.coalesce(F.least("cap", F.col("level") * F.col("w")), F.col("cap")).alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, repeat: int = 2, block: int = 256, shards: int = 64, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> dict[str, DataFrame]:
    """Mix the words of all sources to target weights.

    The words of a source, its documents in hash order, are one stream cut into blocks of ``block``
    words (the last may be shorter). A source's target is a number of slots. Slot k of the e-th pass
    takes the block to which that pass's pseudorandom permutation maps it, so no block is taken
    again before all have been, and none more than ``repeat`` times. The last slot takes only as
    many words of its block as are left. First the number of slots that each output shard gets of each source is
    drawn: a multinomial draw whose total is the source's quota, by counting independent draws, so totals are exact, and
    the shards vary as such draws do. These counts then make the slots: a shard's slots of a source are
    the numbers after those of the shards before it. Slots meet blocks by (source, block index).

    Null texts and texts without words have size 0 and are never taken; null sources are a source;
    repeated rows are separate stretches of the stream (rows that tie in hash, identifier and text are
    interchangeable); an empty table gives empty results.

    Returns the tables ``documents`` (id, th (a hash of the text), source, size, source_size, target, taken, shards: those that its words go to), ``slots`` (src,
    slot, shard, index, words) and ``pieces`` (id, src, index, first, last: the words of a block
    that are the document's), ``shards`` (src, shard, words). The same input gives the same mix.
    """
    sized = staged(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"), F.xxhash64(text_of(text_col)).alias("th")), "sizes")
    targets = staged(source_targets(sized, weights, share, repeat), "targets")
    n = F.ceil(F.col("source_size") / block).cast("long")
    quota = F.round("target").cast("long")
    t = targets.select("src", n.alias("n"), quota.alias("quota"), (F.col("source_size") - (n - 1) * block).alias("short")).filter("quota > 0")
    for e in range(repeat):  # where the short block comes in each pass
        t = t.withColumn(f"at{e}", permuted(F.col("n") - 1, F.col("n"), [F.lit(seed), F.col("src"), F.lit(e).cast("long")], inverse=True) + F.lit(e) * F.col("n"))
    most = F.least(F.col("n") * repeat, F.ceil(F.col("quota") / block) + repeat).cast("long")
    parts = max(8, docs.sparkSession.sparkContext.defaultParallelism)
    chunk = t.withColumn("most", most).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("most") - 1) / CHUNK)))).repartition(parts, F.col("src"), F.col("chunk"))
    # the multinomial draw: how many of the source's slots each shard gets
    draw = F.floor(fraction(F.lit(seed + 1), F.col("src"), F.col("slot")) * shards).cast("int")
    drawn_slots = chunk.select("src", F.explode(F.sequence(F.col("chunk") * CHUNK, F.least((F.col("chunk") + 1) * CHUNK, F.col("most")) - 1)).alias("slot"))
    counts = staged(drawn_slots.groupBy("src", draw.alias("shard")).agg(F.count("*").alias("slots")), "shard-counts")
    # a shard's slots of a source follow those of the shards before it: at most ``shards`` rows a source
    start = F.sum("slots").over(W.partitionBy("src").orderBy("shard").rowsBetween(W.unboundedPreceding, -1))
    ranges = counts.withColumn("start", F.coalesce(start, F.lit(0))).join(t, "src")
    ranges = ranges.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / CHUNK)))).repartition(parts, F.col("src"), F.col("shard"), F.col("chunk"))
    slots = ranges.withColumn("slot", F.explode(F.sequence(F.col("start") + F.col("chunk") * CHUNK, F.col("start") + F.least((F.col("chunk") + 1) * CHUNK, F.col("slots")) - 1)))
    passed = F.floor(F.col("slot") / F.col("n")).cast("long")
    slots = slots.withColumn("index", permuted(F.col("slot") % F.col("n"), F.col("n"), [F.lit(seed), F.col("src"), passed]))
    shorts = sum(F.when(F.col("slot") > F.col(f"at{e}"), 1).otherwise(0) for e in range(repeat))
    before = F.col("slot") * block - shorts * (block - F.col("short"))
    length = F.when(F.col("index") == F.col("n") - 1, F.col("short")).otherwise(block)
    slots = slots.withColumn("words", F.least(length, F.col("quota") - before).cast("long")).filter("words > 0").select("src", "slot", "shard", "index", "words")

    named = sized.join(targets.select(F.col("source").alias("of"), "src", "source_size", "target"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    h = F.xxhash64(F.lit(seed + 2), F.col("id"))
    rows = named.withColumn("h", h).withColumn("bucket", F.pmod(F.shiftrightunsigned("h", 40), F.lit(BUCKETS)).cast("int"))
    rows = running(rows.filter("size > 0"), ["src"], "bucket", [F.col("h"), F.col("id"), F.col("th")], F.col("size"), "first")
    pieces = rows.withColumn("index", F.explode(F.sequence(F.floor(F.col("first") / block), F.floor((F.col("first") + F.col("size") - 1) / block))))
    lo = F.greatest(F.col("first") - F.col("index") * block, F.lit(0)).alias("from_word")
    hi = F.least(F.col("first") + F.col("size") - F.col("index") * block, F.lit(block)).alias("to_word")
    pieces = pieces.select("id", "th", "src", "source", "size", "source_size", "target", F.col("first").alias("stream_at"), "index", lo, hi)
    used = slots.select(F.col("src").alias("s_src"), F.col("index").alias("s_index"), "words", "shard")
    got = F.greatest(F.least("to_word", F.coalesce("words", F.lit(0))) - F.col("from_word"), F.lit(0))
    # slots come out of a few rows of targets, which hides their number from the planner: no broadcast
    taken = pieces.join(used.hint("merge"), (F.col("src") == F.col("s_src")) & (F.col("index") == F.col("s_index")), "left").groupBy("id", "th", "source", "size", "source_size", "target", "stream_at").agg(F.coalesce(F.sum(got), F.lit(0)).cast("long").alias("taken"), F.array_sort(F.collect_set(F.when(got > 0, F.col("shard")))).alias("shards"))
    keep = ["id", "th", "source", "size", "source_size", "target"]
    result = taken.select(*keep, "taken", "shards").unionByName(named.filter("size = 0").select(*keep, F.lit(0).cast("long").alias("taken"), F.array().cast("array<int>").alias("shards")))
    shares = slots.groupBy("src", "shard").agg(F.sum("words").alias("words"))
    return {"documents": result, "slots": slots, "pieces": pieces, "shards": shares}


#: A document in the fixed point of running sums.
ONE = 1 << 30


def drawn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, **how) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them.

    The mix cuts documents at blocks; here a document is drawn as a whole, taken / size times. Fractions are
    rounded by their running sum within the source, in order of size from an offset by hash, so the words of a
    source differ from those taken by less than its longest document. Documents without words (also null texts) stay once;
    null ids and sources, repeated rows and columns of any name are kept as they are; ties in size go by hash; an empty table stays empty.
    """
    mixed = mix_sources(docs, id_col=id_col, text_col=text_col, seed=seed, **how)["documents"]
    # fixed point, so that sums don't depend on their order
    parts = F.round(F.col("taken") / F.col("size") * ONE).cast("long")
    h = F.xxhash64(F.lit(seed + 3), F.col("id"), F.col("th"))
    some = mixed.filter("size > 0").select("id", "th", "source", "size", parts.alias("parts"), h.alias("h"))
    # equal sizes are dealt to 64 buckets; sizes ascend from bucket to bucket
    some = some.withColumn("bucket", F.col("size") * 64 + F.shiftrightunsigned("h", 58))
    some = running(some, ["source"], "bucket", [F.col("h"), F.col("id"), F.col("th"), F.col("parts")], F.col("parts"), "before")
    offset = F.floor(fraction(F.lit(seed + 3), F.col("source")) * ONE).cast("long")
    whole = lambda x: F.floor((x + offset) / ONE)
    times = whole(F.col("before") + F.col("parts")) - whole(F.col("before"))
    drawn_times = some.select("id", "th", times.alias("times")).unionByName(mixed.filter("size = 0").select("id", "th", F.lit(1).cast("long").alias("times")))
    return kept_rows(docs, drawn_times.groupBy("id", F.col("th").alias("key")).agg(F.sum("times").cast("int").alias("times")), F.xxhash64(text_of(text_col)), id_col)


def op1_mixing(spark, sf_dir):
    """All documents with the words that the mix takes of each; see ``mix_sources``."""
    mixed = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))["documents"]
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "shards")
