"""Shards of near-equal bytes by sampled splitters.

Records are ordered by (hash of the text, doc_id, place of the row in the written keys), so equal texts
lie together and no two records share a key. A size-weighted sample of keys gives quantile boundaries
of many more ranges than shards; records are range-partitioned by them and each range is weighed. Ranges
over twice the mean weight are subdivided by splitters sampled from themselves, again until none is
overfull or it holds a single record. Runs of consecutive ranges then make up the shards.

Two bounded things reach the driver: about `sample` keys a round (a record is drawn where its hash falls
under its share, so no partition sends more than its part), and the weights of the ranges (a number a million records beyond 1.5 billion).
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Ranges a shard is made of, at least; a shard's weight is off by about half a range at most.
RANGES = 64
#: Records a range holds on the whole, at most: more records make more ranges, which one task each puts in order.
RANGE_ROWS = 1_000_000
KEY = ("h", "d", "t")


def _sample(keys: DataFrame, n: int, total: int) -> list[tuple[tuple, float]]:
    """About n of keys' records with the weight each stands for, drawn by size, the same ones on every run."""
    each = max(1.0, total / n)
    u = F.pmod(F.xxhash64(F.lit("draw"), *KEY), F.lit(1 << 52)) / float(1 << 52)
    drawn = keys.filter(u < F.col("size") / each).select(*KEY, "size").collect()
    return sorted((tuple(r[c] for c in KEY), max(float(r["size"]), each)) for r in drawn)


def _quantiles(drawn: list[tuple[tuple, float]], parts: int) -> set[tuple]:
    """Keys that cut the drawn weight into `parts` even parts."""
    if not drawn:
        return set()
    upto = np.cumsum([w for _, w in drawn])
    at = np.searchsorted(upto, upto[-1] * np.arange(1, parts) / parts)
    return {drawn[i][0] for i in at.tolist()}


def _packed(*columns) -> np.ndarray:
    """Three longs a row as 24 bytes that sort as the longs do."""
    flat = np.column_stack([np.asarray(c, np.int64).view(np.uint64) ^ np.uint64(1 << 63) for c in columns]).astype(">u8")
    return np.ascontiguousarray(flat).view("S24").ravel()


def _range_of(splitters: list[tuple]):
    """Column of the number of splitters at or below a record's key."""
    edges = _packed(*zip(*splitters)) if splitters else np.zeros(0, "S24")

    @F.pandas_udf("int")
    def place(h: pd.Series, d: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, _packed(h, d, t), "right").astype(np.int32))

    return place(*KEY)


def _weigh(keys: DataFrame, splitters: list[tuple]) -> dict[int, tuple]:
    r = keys.withColumn("range", _range_of(splitters)).groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    return {x["range"]: (x["bytes"], x["rows"]) for x in r.collect()}


def split_ranges(keys: DataFrame, shards: int, sample: int = 16384, rounds: int = 32):
    """(splitters, weights by range) with no range over twice the mean weight unless it is one record."""
    total, rows = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    want = shards * max(RANGES, -(-rows // (shards * RANGE_ROWS)))
    sample = max(sample, 8 * want)
    splitters = sorted(_quantiles(_sample(keys, sample, total), want))
    weights = _weigh(keys, splitters)
    most = 2 * total / want
    for _ in range(rounds):
        over = [r for r, w in weights.items() if w[0] > most and w[1] > 1]
        if not over:
            break
        inside = keys.withColumn("range", _range_of(splitters)).filter(F.col("range").isin(over)).drop("range")
        more = _sample(inside, sample, sum(weights[r][0] for r in over))
        named, edges = [k for k, _ in more], set(splitters)
        for r in over:
            lo = bisect.bisect_left(named, splitters[r - 1]) if r else 0
            hi = bisect.bisect_left(named, splitters[r]) if r < len(splitters) else len(named)
            own = more[lo:hi]
            edges |= _quantiles(own, int(2 * weights[r][0] // most) + 1)
        if len(edges) == len(splitters):
            break
        splitters = sorted(edges)
        weights = _weigh(keys, splitters)
    return splitters, weights


def shard_by_bytes(docs: DataFrame, shards: int = 24, sample: int = 16384) -> DataFrame:
    """documents -> doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null).

    size is the UTF-8 bytes of the text plus 8; a null text has none and the CRC of nothing, 0. Equal
    texts lie in one shard or in neighbouring ones where a border or a group larger than a shard cuts
    them. Slots are gapless from 0 in every shard. Rows that repeat a doc_id each get a slot, and any
    number of equal rows is dealt evenly; a null doc_id sorts first. Other columns are ignored. Empty
    in, empty out.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keys = docs.select(
        F.col("doc_id").cast("long"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
        F.monotonically_increasing_id().alias("t"),
    ).withColumn("d", F.coalesce("doc_id", F.lit(-(1 << 63))))
    # Written once, so that a row keeps its place t whoever reads it again.
    keys = materialize(keys, "shard-keys")
    splitters, weights = split_ranges(keys, shards, sample)
    total = sum(w[0] for w in weights.values())
    plan, before, used = [], 0, [0] * shards
    for r in range(len(splitters) + 1):
        size, rows = weights.get(r, (0, 0))
        shard = min(shards - 1, int((before + size / 2) * shards // total)) if total else 0
        plan.append((r, shard, used[shard]))
        used[shard] += rows
        before += size
    where = keys.sparkSession.createDataFrame(plan, "range int, shard int, first long")
    order = Window.partitionBy("range").orderBy(*KEY)
    placed = keys.withColumn("range", _range_of(splitters)).join(F.broadcast(where), "range")
    slot = F.col("first") + F.row_number().over(order) - 1
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
