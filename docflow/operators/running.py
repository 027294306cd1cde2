"""Running aggregates over logs of which one key may hold any share: positions, exponential averages, moving means.

No window has a key of the log alone: rows get their position from a range partitioning, positions are cut into
bounded buckets, and what crosses a bucket's border is composed (averages) or carried over (means).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cgraph import cut

#: Rows of a bucket.
BUCKET = 1024


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str = "pos") -> DataFrame:
    """df with the position of each row among its key's, from 0; ties stand in any order unless `order` is total."""
    ranged = cut(df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_block", F.spark_partition_id()))
    sizes = ranged.groupBy(*keys, "_block").agg(F.count("*").alias("_n"))
    # As many rows as keys and partitions that meet.
    ahead = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_block", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    own = ranged.withColumn(name, F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(*order)) - 1)
    same = F.lit(True)
    for k in [*keys, "_block"]:
        same = same & own[k].eqNullSafe(offsets[k])
    return own.join(offsets, same).select(*[own[c] for c in df.columns], (own[name] + offsets["_ahead"]).cast("long").alias(name))


def composed(rows: DataFrame, keys: list[str], maps: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(keys, pos) and maps x -> a x + b of each row -> keys and the composition over all rows in order, as <name>_a and <name>_b.

    Up to BUCKET rows of neighbouring positions become one map, then as many of those, until one is left for a key.
    """
    parts = [f"{n}_{p}" for n in maps for p in "ab"]
    now = rows.select(*keys, "pos", *[c.cast("double").alias(f"{n}_{p}") for n, ab in maps.items() for p, c in zip("ab", ab)])
    most = now.agg(F.max("pos")).first()[0] or 0
    start = ", ".join(f"'{n}_a', 1D, '{n}_b', 0D" for n in maps)
    step = ", ".join(f"'{n}_a', m.{n}_a * x.{n}_a, '{n}_b', m.{n}_a * x.{n}_b + m.{n}_b" for n in maps)
    for _ in range(max(1, math.ceil(math.log(most + 1, BUCKET) + 1e-9))):
        listed = now.groupBy(*keys, F.floor(F.col("pos") / BUCKET).alias("pos")).agg(F.array_sort(F.collect_list(F.struct("pos", *parts))).alias("ms"))
        now = listed.select(*keys, "pos", F.expr(f"aggregate(ms, named_struct({start}), (x, m) -> named_struct({step}))").alias("m")).select(*keys, "pos", *[F.col(f"m.{p}").alias(p) for p in parts])
    return now.select(*keys, *parts)


def ema_map(value: Column, counts: Column, alpha: float) -> tuple[Column, Column]:
    """A row's step of an exponential average; rows that do not count leave it as it is."""
    return F.when(counts, 1 - alpha).otherwise(1.0), F.when(counts, alpha * value).otherwise(0.0)


def exponential_average(df: DataFrame, keys: list[str], order: list[Column], value: str, alpha: float) -> DataFrame:
    """(keys, ema, n): the exponential average of each key's values in order, the first value being the start; null values do not count."""
    rows = numbered(df.filter(F.col(value).isNotNull()), keys, order)
    first = F.col("pos") == 0
    a, b = F.when(first, 0.0).otherwise(1 - alpha), F.when(first, F.col(value)).otherwise(alpha * F.col(value))
    out = composed(rows, keys, {"ema": (a, b)})
    n = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    return out.select(*keys, F.col("ema_b").alias("ema")).join(n, keys)


def moving_mean(df: DataFrame, keys: list[str], order: list[Column], value: str, last: int, name: str) -> DataFrame:
    """df with the mean of the last `last` values of a key at each row; a bucket gets the rows before its first that it needs."""
    size = max(BUCKET, 4 * last)
    rows = numbered(df, keys, order).withColumn("_bucket", F.floor(F.col("pos") / size))
    behind = rows.filter(F.col("pos") % size > size - last).withColumn("_bucket", F.col("_bucket") + 1)
    both = rows.withColumn("_own", F.lit(True)).unionByName(behind.withColumn("_own", F.lit(False)))
    w = Window.partitionBy(*keys, "_bucket").orderBy("pos").rowsBetween(-(last - 1), 0)
    return both.withColumn(name, F.avg(value).over(w)).filter("_own").select(*df.columns, name)
