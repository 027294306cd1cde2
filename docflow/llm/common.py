"""Shared helpers of the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar
from itertools import combinations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on local[...] a fresh one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


#: Folders that materialize() writes while settle() waits for its result.
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    if (held := _written.get()) is not None:
        held.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """materialize() what make() returns, then delete the tables that were written on the way to it.

    For callers that read the result only; after a failure all tables stay.
    """
    before = _written.set([])
    try:
        out = materialize(make(), name)
        on_the_way = _written.get()[:-1]
    finally:
        _written.reset(before)
    _delete(spark, on_the_way)
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that materialize() wrote and nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession, {f.rpartition("/")[0] for f in df.inputFiles()})


def _delete(spark: SparkSession, paths) -> None:
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """drop(), and let go of finished shuffles: their files go when the driver's JVM collects the plans that made them."""
    drop(*tables)
    if tables:
        gc.collect()
        tables[0].sparkSession._jvm.System.gc()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores behind those that df has already (Spark takes no note of case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def share_below(share: float, *columns):
    """Rows drawn by a hash of the columns with probability `share`, the same ones on every run."""
    return F.pmod(F.xxhash64(F.lit("draw"), *columns), F.lit(1 << 52)) < F.lit(int(min(1.0, share) * (1 << 52)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_slices(batch: pa.RecordBatch, column: str, max_bytes: int = 4 << 20):
    """Cut an Arrow batch into row ranges of about max_bytes of text, a long text standing alone."""
    at, size = 0, 0
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    for i, n in enumerate(lengths):
        if i > at and size + n > max_bytes:
            yield batch.slice(at, i - at)
            at, size = i, 0
        size += n
    if at < batch.num_rows:
        yield batch.slice(at)


def block_masks(blocks: int, radius: int, bits: int = 64) -> list[int]:
    """Masks such that two words within `radius` bits agree under one mask at least (pigeonhole).

    The word is cut into `blocks` runs of bits; `radius` differing bits spoil at most `radius`
    of them, so some choice of blocks - radius runs is equal in both.
    """
    edges = [round(i * bits / blocks) for i in range(blocks + 1)]
    runs = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:])]
    masks = [sum(c) for c in combinations(runs, blocks - radius)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, v) links of longs -> (node, root), root the smallest node that node reaches.

    Alternating large-star and small-star rounds: every round is two aggregations with map-side
    minima and two equi-joins whose hot keys AQE can split; the links of a round are written to the
    shared folder and deleted once the next round's are. Ends when a round changes nothing (rounds grow with the logarithm of the longest
    chain). Nodes without links are not in the result.
    """
    def state(df: DataFrame):
        return df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()

    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct()
    e = materialize(e, "links")
    before = state(e)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low2, "u")
            .select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("x"))
            .select(F.col("x.u").alias("u"), F.col("x.m").alias("v"))
            .filter("u > v")
            .distinct()
        )
        last, e = e, materialize(small, "links")
        drop(last)
        after = state(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
