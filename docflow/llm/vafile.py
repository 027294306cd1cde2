"""Exact top-k inner products through a vector-approximation file.

The VA-file holds one byte a component: the cell of an even grid between the component's smallest
and largest value. A scan of the cells alone gives every (query, vector) pair a lower and an upper
bound; a task keeps, for a query, only pairs whose upper bound reaches its k-th lower bound, and the
k-th lower bound over all tasks cuts again. Exact vectors are then read in order of their upper
bounds: first each query's best `first_read`, whose k-th exact score makes the rest certain except
for those whose upper bound still reaches it.

The file has one entry for each distinct (vec_id, vector) with the number of its rows, so rows that
repeat an id are candidates each. Bounds are doubles, widened by more than their rounding, so that they
hold for components of any size. Queries go to tasks in broadcast blocks of at most `query_block`
vectors; a block's floors are broadcast too, one number a query. Equal vectors beyond the k + 1
smallest ids of an Arrow batch can be in no answer, so the file leaves them out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

CELLS = 256
#: Share of the sum of absolute products by which bounds are widened; doubles err by far less.
SLACK = 2.0**-40
_LONG = (1 << 63) - 1
#: What names an entry: its id, whether it has none, and a hash that tells vectors of one id apart.
ENTRY = ("none", "vec_id", "h")


def integer_vectors(embeddings: DataFrame, scale: int = 1024) -> DataFrame:
    """(none, vec_id, h, v array<long>, n): floor(scale * x) of each distinct row and how often it occurs.

    Vectors null, or with null or non-finite parts, go. A null vec_id is told by `none`; components
    beyond a long stop at its ends.
    """
    x = F.col("embedding").cast("array<double>")
    whole = F.expr("forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    ints = F.transform(x, lambda c: F.floor(F.least(F.greatest(c * scale, F.lit(-9.2e18)), F.lit(9.2e18))))
    kept = embeddings.filter(F.col("embedding").isNotNull() & whole)
    rows = kept.select(F.col("vec_id").isNull().alias("none"), F.coalesce(F.col("vec_id").cast("long"), F.lit(0)).alias("vec_id"), ints.alias("v"))
    return rows.groupBy("none", "vec_id", "v").agg(F.count("*").alias("n")).select("none", "vec_id", F.xxhash64("v").alias("h"), "v", "n")


def _matrix(column, width: int | None = None) -> np.ndarray:
    """Rows of a list column of longs; shorter vectors are filled with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    width = int(lengths.max(initial=0)) if width is None else width
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def grid(vectors: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Smallest value and cell width of each component, and the largest sum of products (as wide as the vectors)."""
    per = vectors.select(F.posexplode("v").alias("d", "x"), F.size("v").alias("w")).groupBy("d").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.min("w").alias("w")).orderBy("d").collect()
    shortest = vectors.agg(F.min(F.size("v"))).first()[0]
    # A component that shorter vectors lack is zero in them.
    ends = [(r.lo, r.hi) if shortest > r.d else (min(r.lo, 0), max(r.hi, 0)) for r in per]
    return np.array([lo for lo, _ in ends], np.int64), np.array([(hi - lo) // CELLS + 1 for lo, hi in ends], np.int64), sum(max(abs(lo), abs(hi)) ** 2 for lo, hi in ends)


def build_file(vectors: DataFrame, lo: np.ndarray, width: np.ndarray, k: int) -> DataFrame:
    """(none, vec_id, h, n, cells binary): the approximations, without equal vectors that k + 1 smaller ids shut out."""
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            none, ids = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy()
            m = _matrix(b.column(3), len(lo))
            order = np.lexsort((ids, none, *m.T[::-1]))
            same = np.concatenate([[False], (m[order][1:] == m[order][:-1]).all(1)])
            start = np.maximum.accumulate(np.where(same, 0, np.arange(len(ids))))
            keep = order[np.arange(len(ids)) - start <= k]
            # Values far from the grid's start would overflow as longs; unsigned differences do not.
            cells = np.clip((m[keep].view(np.uint64) - lo.view(np.uint64)) // width.view(np.uint64), 0, CELLS - 1).astype(np.uint8)
            at = pa.array(keep)
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(at) for i in (0, 1, 2, 4)), pa.array([c.tobytes() for c in cells], pa.binary())], names=[*ENTRY, "n", "cells"])

    return vectors.mapInArrow(run, "none boolean, vec_id long, h long, n long, cells binary")


def _bounds(approx: DataFrame, queries, lo: np.ndarray, width: np.ndarray, k: int) -> DataFrame:
    """(query, none, vec_id, h, n, low, high): entries that can be among a query's k best, by what one task has seen.

    A query is the number of its entry in `queries`; n leaves out the query's own row.
    """
    shared = approx.sparkSession.sparkContext.broadcast(queries)

    def run(batches):
        (qnone, qid, qh), q = shared.value
        up, down, size = np.maximum(q, 0), np.minimum(q, 0), np.abs(q)
        best = np.full((len(qid), k), -np.inf)
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                none, ids, h, n = (part.column(i).to_numpy(zero_copy_only=False) for i in range(4))
                cells = np.frombuffer(b"".join(part.column(4).to_pylist()), np.uint8).reshape(len(ids), -1)
                low = lo.astype(np.float64) + cells * width.astype(np.float64)
                high = low + (width - 1)
                slack = size @ np.maximum(np.abs(low), np.abs(high)).T * SLACK
                # Scores stop at the ends of a long, so bounds do.
                most, least = (np.clip(x, -(2.0**63), 2.0**63) for x in (up @ high.T + down @ low.T + slack, up @ low.T + down @ high.T - slack))
                own = (qid[:, None] == ids) & (qh[:, None] == h) & (qnone[:, None] == none)
                alone = own & (n == 1)
                most[alone], least[alone] = -np.inf, -np.inf
                best = -np.sort(-np.concatenate([best, least], 1), 1)[:, :k]
                r, c = np.nonzero((most >= best[:, -1:]) & (most > -np.inf))
                yield pa.RecordBatch.from_arrays([pa.array(r.astype(np.int32)), *(part.column(i).take(pa.array(c)) for i in range(3)), pa.array(n[c] - own[r, c]), pa.array(least[r, c]), pa.array(most[r, c])], names=["query", *ENTRY, "n", "low", "high"])

    return approx.mapInArrow(run, "query int, none boolean, vec_id long, h long, n long, low double, high double")


def _exact(pairs: DataFrame, vectors: DataFrame, queries: DataFrame, small: bool) -> DataFrame:
    """Adds the exact score to (query, none, vec_id, h, n)."""
    met = pairs.join(vectors.select(*ENTRY, "v"), list(ENTRY)).join(F.broadcast(queries.select("query", F.col("v").alias("q"))), "query")
    names = ("query", "none", "vec_id", "h", "n")
    if small:
        zero = F.lit(0).cast("long")
        score = F.aggregate(F.zip_with("q", "v", lambda a, b: F.coalesce(a * b, zero)), zero, lambda s, x: s + x)
        return met.select(*names, score.alias("score"))

    def run(batches):
        for b in batches:
            score = [sum(x * y for x, y in zip(p, q)) for p, q in zip(b.column(5).to_pylist(), b.column(6).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array([max(-_LONG, min(_LONG, s)) for s in score], pa.int64())], names=[*names, "score"])

    return met.select(*names, "v", "q").mapInArrow(run, "query int, none boolean, vec_id long, h long, n long, score long")


def top_k(embeddings: DataFrame, every: int = 100, k: int = 10, query_block: int = 4096, first_read: int = 32) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of each query row, exact, ties to the smaller vec_id.

    Queries are rows whose vec_id is divisible by `every`; candidates are all rows but the query's own:
    a row that repeats a vec_id, with the same vector or another, is one more candidate and, if the id is
    a query's, one more query with ten rows of its own. A null vec_id is a candidate, last among ties, and
    no query. Vectors null, or with null or non-finite components, take no part; an empty vector scores 0.
    Of vectors of different lengths the shorter counts as filled with zeros. Components may have any size:
    where scores could leave a long they are summed as whole numbers and stop at the ends of a long.
    Other columns are ignored. Empty in, empty out.
    """
    vectors = materialize(integer_vectors(embeddings), "vectors")
    asked = vectors.filter(~F.col("none") & (F.col("vec_id") % every == 0))
    n = asked.count()
    lo, width, most = grid(vectors)
    small = most < 1 << 62
    approx = materialize(build_file(vectors, lo, width, k), "va-file")
    blocks, out = max(1, -(-n // query_block)), None
    for i in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64(*ENTRY), F.lit(blocks)) == i).orderBy(*ENTRY).collect()
        m = np.zeros((len(rows), len(lo)))
        for j, r in enumerate(rows):
            m[j, : len(r.v)] = r.v
        names = (np.zeros(len(rows), bool), np.array([r.vec_id for r in rows], np.int64), np.array([r.h for r in rows], np.int64))
        queries = vectors.sparkSession.createDataFrame([(j, r.vec_id, r.n, r.v) for j, r in enumerate(rows)], "query int, query_id long, times long, v array<long>")
        pairs = materialize(_bounds(approx, (names, m), lo, width, k), "bounds")
        by_low = Window.partitionBy("query").orderBy(F.desc("low"))
        floor = pairs.select("query", "low").withColumn("i", F.row_number().over(by_low)).filter(F.col("i") <= k)
        floor = floor.groupBy("query").agg(F.when(F.count("*") >= k, F.min("low")).alias("floor"))
        can = pairs.join(F.broadcast(floor), "query").filter(F.col("floor").isNull() | (F.col("high") >= F.col("floor"))).drop("floor", "low")
        by_high = Window.partitionBy("query").orderBy(F.desc("high"), *ENTRY)
        first = can.withColumn("i", F.row_number().over(by_high)).filter(F.col("i") <= max(first_read, k)).drop("i", "high")
        read = materialize(_exact(first, vectors, queries, small), "read")
        by_score = Window.partitionBy("query").orderBy(F.desc("score"), "none", "vec_id", "h")
        # The k-th best row, an entry counting as often as it occurs.
        sure = read.withColumn("i", F.sum("n").over(by_score.rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("i") >= k)
        sure = sure.groupBy("query").agg(F.max("score").alias("sure"))
        rest = can.join(F.broadcast(sure), "query", "left").filter(F.col("sure").isNull() | (F.col("high") >= F.col("sure")))
        rest = rest.join(read.select("query", *ENTRY), ["query", *ENTRY], "left_anti").drop("sure", "high")
        both = read.union(_exact(rest, vectors, queries, small).select(read.columns))
        ranked = both.withColumn("i", F.row_number().over(by_score)).filter(F.col("i") <= k).drop("i")
        copies = ranked.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("n"), F.lit(k).cast("long")))))
        best = copies.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k)
        best = best.join(F.broadcast(queries.drop("v")), "query").withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
        best = best.select("query_id", "rank", F.when(~F.col("none"), F.col("vec_id")).alias("vec_id"), "score")
        if blocks > 1:
            best = materialize(best, "answers")
        out = best if out is None else out.union(best)
    return out
