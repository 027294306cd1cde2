"""Mixing sources to target weights, with DataFrame functions only.

Each source is one stream of words, its documents laid end to end and cut into blocks of `block`
words. A source takes as many slots as its target has blocks. A pseudorandom permutation of all slots
deals them to output shards of `shard_slots`, so the source counts of a shard are a multinomial draw
given the totals (without replacement): a shard's counts vary as drawn ones do, and the totals stand.
A source's slots run through pseudorandom permutations of its block indices, one for each epoch
(swap-or-not shuffles, which permute any number of blocks exactly); joining on (source, index) gives
each slot its block.

Stream positions come from a two-level prefix sum: documents are dealt by hash into as many buckets
as the square root of the row count, so a hot source spreads over its buckets and neither the rows of
a bucket nor the buckets of a source grow faster than that root.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialize

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3
BLOCK = 64
ROUNDS = 12
#: Slots that stay together when slots are dealt to tasks, slots a task has in mind, and tasks at most.
PART, TASK_SLOTS, MOST_TASKS = 4096, 1 << 18, 20_000


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size) -> with target: shares by weight, stopped at cap * size, excess reshared.

    Sources come in code-point order, null last, and take the weights in turn. Sources stop in the
    order of cap * size / weight, so the level at which the rest share is a running sum away.
    """
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (nth % len(weights)).cast("int") + 1)
    s = sizes.withColumn("w", w).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    by = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    upto, whole = by.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = s.withColumn("left_t", F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(upto), F.lit(0.0)))
    s = s.withColumn("left_w", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(upto), F.lit(0.0)))
    s = s.withColumn("level", F.col("left_t") / F.col("left_w"))
    s = s.withColumn("free", F.col("level") * F.col("w") <= F.col("most"))
    level = F.min(F.when(F.col("free"), F.struct(F.col("most") / F.col("w"), F.col("level").alias("level")))).over(whole)["level"]
    return s.withColumn("target", F.least(F.col("most"), F.col("w") * F.coalesce(level, F.lit(float("inf"))))).select("source", "source_size", "target")


def permuted(i: Column, n: Column, *salt: Column) -> Column:
    """Swap-or-not: a pseudorandom permutation of 0 .. n - 1, for any n.

    One fold over the rounds: a chain of projections would run in generated code, but Catalyst's
    constraints grow with two to the power of its length.
    """
    def swap(x, r):
        other = F.pmod(F.pmod(F.xxhash64(F.lit("key"), r, n, *salt), n) - x, n)
        return F.when(F.pmod(F.xxhash64(F.greatest(x, other), r, n, *salt), F.lit(2)) == 1, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), i, swap)


def laid_out(docs: DataFrame) -> DataFrame:
    """documents -> doc_id, source, size, from: the place of the document's words in its source's stream."""
    size = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    slim = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), size.alias("size"), F.xxhash64("text").alias("h"))
    slim = materialize(slim, "mix-sizes")
    buckets = math.isqrt(slim.count()) + 1
    slim = slim.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "h"), F.lit(buckets)))
    sums = slim.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("bucket_from", F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0).cast("long"))).drop("bucket_size")
    sums = sums.withColumnsRenamed({"source": "source_", "bucket": "bucket_"})
    inside = Window.partitionBy("source", "bucket").orderBy("doc_id", "h", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = slim.withColumn("in_from", F.coalesce(F.sum("size").over(inside), F.lit(0).cast("long")))
    on = F.col("source").eqNullSafe(F.col("source_")) & (F.col("bucket") == F.col("bucket_"))
    return placed.join(sums, on).select("doc_id", "source", "size", (F.col("bucket_from") + F.col("in_from")).alias("from"))


def draw_slots(goals: DataFrame, block: int = BLOCK, shard_slots: int = 65536, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) -> source, out_shard, slot, index: the block each slot of a shard takes.

    goals has a row a source and is read twice: write it first.
    """
    g = goals.filter("source_size > 0").withColumn("blocks", F.ceil(F.col("source_size") / block))
    want = F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long")
    g = g.withColumn("slots", F.least(want, cap * F.col("blocks"))).filter("slots > 0")
    total = g.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    ahead = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    g = g.withColumn("before", F.coalesce(F.sum("slots").over(ahead), F.lit(0).cast("long")))
    g = g.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / PART))))
    tasks = max(g.sparkSession.sparkContext.defaultParallelism, min(total // TASK_SLOTS + 1, MOST_TASKS))
    g = g.repartition(tasks, "source", "part")
    own = F.sequence(F.col("part") * PART, F.least((F.col("part") + 1) * PART, F.col("slots")) - 1)
    g = g.withColumn("i", F.explode(own))
    index = permuted(F.col("i") % F.col("blocks"), F.col("blocks"), F.col("source"), F.floor(F.col("i") / F.col("blocks")))
    g = g.select("source", index.alias("index"), permuted(F.col("before") + F.col("i"), F.lit(total).cast("long")).alias("place"))
    return g.select("source", F.floor(F.col("place") / shard_slots).alias("out_shard"), (F.col("place") % shard_slots).alias("slot"), "index")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP, block: int = BLOCK) -> DataFrame:
    """documents -> doc_id, size, source_size, target, taken.

    size is the words of the text (null or white space: 0, and nothing is taken). The null source is
    one more source, after all others. A source's taken words differ from its target by a block or so
    for each output shard, and no document exceeds cap times its size. Reruns agree: all draws are
    hashes. Repeated rows and doc_ids are documents each. Empty in, empty out.
    """
    laid = materialize(laid_out(docs), "mix-places")
    goals = materialize(targets(laid.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap), "mix-targets")
    times = draw_slots(goals, block, cap=cap).groupBy(F.col("source").alias("s"), F.col("index").alias("i")).agg(F.count("*").alias("times"))
    last = F.col("from") + F.col("size") - 1
    pieces = laid.filter("size > 0").withColumn("i_", F.explode(F.sequence(F.floor(F.col("from") / block), F.floor(last / block))))
    overlap = F.least(last, F.col("i_") * block + block - 1) - F.greatest(F.col("from"), F.col("i_") * block) + 1
    pieces = pieces.withColumn("overlap", overlap)
    met = pieces.join(times.hint("merge"), F.col("source").eqNullSafe(F.col("s")) & (F.col("i_") == F.col("i")), "left")
    used = met.groupBy("source", "from", "doc_id", "size").agg(F.sum(F.col("overlap") * F.coalesce("times", F.lit(0).cast("long"))).alias("taken"))
    none = laid.filter("size = 0").select("source", "from", "doc_id", "size", F.lit(0).cast("long").alias("taken"))
    g = goals.withColumnRenamed("source", "g")
    return used.union(none).join(g, F.col("source").eqNullSafe(F.col("g"))).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP, block: int = BLOCK) -> DataFrame:
    """documents -> the same columns, each document as often as mix() takes it, whole.

    A document of which `taken` of `size` words are taken comes taken / size times, the broken part
    rounded by a hash of its doc_id, so that a source keeps its share of words on the whole and no
    document comes more than cap times. Documents without words are not in the mixture. Rows that share
    a doc_id (null is one more) come equally often. Columns of any name are carried. Empty in, empty out.
    """
    n, key, copy = fresh(docs, "copies", "id", "copy")
    used = mix(docs, weights, cap, block).filter("taken > 0").select("doc_id", "size", "taken")
    used = used.groupBy("doc_id").agg(F.sum("size").alias("size"), F.sum("taken").alias("taken"))
    share = F.col("taken") / F.col("size")
    u = F.pmod(F.xxhash64(F.lit("copies"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    copies = used.select(F.col("doc_id").alias(key), F.floor(share + u).cast("int").alias(n)).filter(F.col(n) > 0)
    met = docs.join(copies, docs["doc_id"].cast("long").eqNullSafe(F.col(key)))
    return met.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*[F.col(f"`{c}`") for c in docs.columns])
