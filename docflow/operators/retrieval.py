"""Retrieval of all queries over a whole corpus: BM25, dense, fusion, expansion, caches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docflow.functions.text import cosine, embed_key, tokens

from .cgraph import written

# BM25 parameters, the rank constant of fusion, the share of its parent's score a sibling gets.
K1, B, RRF_K, SIBLING_SHARE = 1.5, 0.75, 60, 0.85


def bm25_index(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """RET1: (scope, chunk_id, text) -> postings (scope, term, chunk_id, tf, dl) and scope sizes (n, avgdl).

    The document frequency of a term is a count over its postings and is taken at search time, for
    the terms that are asked.
    """
    t = chunks.select("scope", "chunk_id", tokens("text").alias("terms")).withColumn("dl", F.size("terms"))
    stats = t.groupBy("scope").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    postings = t.select("scope", "chunk_id", "dl", F.explode("terms").alias("term")).groupBy("scope", "term", "chunk_id", "dl").agg(F.count("*").alias("tf"))
    return postings, stats


#: Asked terms up to which they are sent to every task (about 10 MB), instead of shuffling every token to them.
SENT_TERMS = 100_000


def sent(df: DataFrame) -> DataFrame:
    """df marked to be sent to every task, if it has few rows; so what meets it stays in its tasks, whatever share one key has."""
    return F.broadcast(df) if df.limit(SENT_TERMS + 1).count() <= SENT_TERMS else df


def asked_postings(chunks: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings of the asked (scope, term) rows, and scope sizes (n, avgdl), from one pass over the chunks.

    Each chunk's tokens meet the asked terms before they leave their task; what is not asked goes, but for one row
    a chunk without a term, which carries its length for the scope's sizes.
    """
    known = terms.withColumn("asked", F.lit(True))
    t = chunks.select("scope", "chunk_id", tokens("text").alias("terms")).withColumn("dl", F.size("terms"))
    each = t.select("scope", "chunk_id", "dl", F.explode_outer(F.concat("terms", F.array(F.lit(None).cast("string")))).alias("term"))
    met = each.join(sent(known), ["scope", "term"], "left")
    met = met.filter(F.col("asked") | F.col("term").isNull()).select("scope", "chunk_id", "dl", "term")
    every = written(met.groupBy("scope", "chunk_id", "dl", "term").agg(F.count("*").alias("tf")))
    stats = written(every.filter("term is null").groupBy("scope").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")))
    return every.filter("term is not null"), stats


def bm25_search(chunks: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """RET2: (query_id, scope, query) -> query_id, chunk_id, score, place: the k best with a score over 0.

    A term repeated in a query counts again. Ties go to the smaller chunk_id. Postings of common words are met only by chunks that can
    still be among the best (MaxScore): a chunk's score on its query's rarest term alone bounds the k-th score from below; terms whose
    highest parts together stay under it cannot bring a chunk in, so they add to chunks that other terms found.
    """
    asked = queries.select("query_id", "scope", F.explode(tokens("query")).alias("term")).groupBy("query_id", "scope", "term").agg(F.count("*").alias("qtf"))
    postings, stats = asked_postings(chunks, asked.select("scope", "term").distinct())
    norm = F.col("tf") + K1 * (1 - B + B * F.greatest(F.col("dl"), F.lit(1)) / F.greatest(F.col("avgdl"), F.lit(1e-9)))
    impact = written(postings.join(sent(stats), "scope").select("scope", "term", "chunk_id", (F.col("tf") * (K1 + 1) / norm).alias("impact")))
    terms = impact.groupBy("scope", "term").agg(F.count("*").alias("df"), F.max("impact").alias("most"))
    weighed = asked.join(terms, ["scope", "term"]).join(sent(stats), "scope")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = written(weighed.select("query_id", "scope", "term", "df", (F.col("qtf") * idf).alias("weight"), (F.col("qtf") * idf * F.col("most")).alias("bound")))
    part = lambda w: impact.join(sent(w), ["scope", "term"]).select("query_id", "scope", "chunk_id", (F.col("weight") * F.col("impact")).alias("part"))
    rarest = weighed.filter(F.col("df") >= k).groupBy("query_id").agg(F.min_by(F.struct("scope", "term", "weight"), F.struct("df", "term")).alias("r")).select("query_id", "r.*")
    floor = top(part(rarest).withColumnRenamed("part", "score"), k).groupBy("query_id").agg(F.min("score").alias("floor"))
    # Terms from the lowest bound up: as long as the bounds together stay under the floor they find no chunk of their own.
    run = F.sum("bound").over(Window.partitionBy("query_id").orderBy("bound", "term").rowsBetween(Window.unboundedPreceding, 0))
    staged = written(weighed.withColumn("sum", run).join(floor, "query_id", "left").withColumn("finds", F.coalesce(F.col("sum") >= F.col("floor") - 1e-6, F.lit(True))))
    found = part(staged.filter("finds"))
    rest = staged.filter("not finds").select("query_id", "scope", "term", "weight")
    added = found.select("query_id", "scope", "chunk_id").distinct().join(sent(rest), ["query_id", "scope"]).join(impact, ["scope", "term", "chunk_id"])
    every = found.select("query_id", "chunk_id", "part").union(added.select("query_id", "chunk_id", F.col("weight") * F.col("impact")))
    return top(every.groupBy("query_id", "chunk_id").agg(F.sum("part").alias("score")).filter("score > 0"), k)


def top(scored: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "chunk_id")
    return scored.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k).select("query_id", "chunk_id", "score", "place")


#: Vectors of a cell and queries of a block at most, and products held at once by a task.
CELL, ASKED, HELD = 65_536, 4096, 2**23
#: Scores are ranked to nine digits, so those less than this apart may tie.
APART = 3e-9


def _rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where the rows of a list column start and end, and all their values."""
    return np.asarray(column.offsets), np.asarray(column.values, dtype=np.float64)


def _sums(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows, added in order, as cosine() adds."""
    out = np.zeros(len(a))
    for x, y in zip(a.T, b.T):
        out += x * y
    return out


def nearest(vectors: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """(query_id, chunk_id, score): for each query of a block the pairs of a cell that can be among its k best, with what cosine() gives.

    Products of matrices say which vectors come near; only these are scored as cosine() does. Equal vectors are one, and of equal
    scores the k smallest chunk_ids are enough.
    """
    if not vectors.num_rows or not queries.num_rows:
        return pa.table({"query_id": queries.column("query_id").slice(0, 0), "chunk_id": vectors.column("chunk_id").slice(0, 0), "score": pa.array([], pa.float64())})
    vectors = vectors.take(pc.sort_indices(vectors, sort_keys=[("chunk_id", "ascending")], null_placement="at_start"))
    (v_at, v_all), (q_at, q_all) = (_rows(t.column(c).combine_chunks()) for t, c in ((vectors, "v"), (queries, "q")))
    same: dict[tuple, list[int]] = {}
    for i in range(vectors.num_rows):
        rows = same.setdefault((v_at[i + 1] - v_at[i], v_all[v_at[i] : v_at[i + 1]].tobytes()), [])
        if len(rows) < k:
            rows.append(i)
    groups = list(same.values())
    first = np.array([rows[0] for rows in groups], dtype=np.int64)
    sizes, asked = (v_at[1:] - v_at[:-1])[first], q_at[1:] - q_at[:-1]
    out: list[tuple] = []
    for size in np.unique(asked):
        own, near = np.flatnonzero(asked == size), np.flatnonzero(sizes == size)
        part = lambda values, starts: values[starts[:, None] + np.arange(size)]  # noqa: B023, E731
        v = part(v_all, v_at[first[near]])
        norm = np.sqrt(_sums(v, v))
        for some in np.array_split(own, max(1, -(-len(own) * len(groups) // HELD))):
            q = part(q_all, q_at[some])
            q_norm, about = np.sqrt(_sums(q, q)), np.zeros((len(some), len(groups)))
            good = (q_norm > 1e-9)[:, None] & (norm > 1e-9)[None]
            about[:, near] = np.where(good, q @ v.T / np.where(good, q_norm[:, None] * norm[None], 1.0), 0.0)
            if len(groups) > k:
                floor = np.partition(about, len(groups) - k, axis=1)[:, len(groups) - k]
                at, of = np.nonzero(about >= floor[:, None] - APART)
            else:
                at, of = np.nonzero(np.ones_like(about, dtype=bool))
            score, place = np.zeros(len(at)), np.searchsorted(near, of)
            place[place == len(near)] = 0
            met = (sizes[of] == size) & (q_norm[at] > 1e-9)
            met[met] &= norm[place[met]] > 1e-9
            score[met] = _sums(q[at[met]], v[place[met]]) / (q_norm[at[met]] * norm[place[met]])
            times = np.array([len(groups[g]) for g in of], dtype=np.int64)
            row = np.array([i for g in of for i in groups[g]], dtype=np.int64)
            at, score = np.repeat(at, times), np.repeat(score, times)
            order = np.lexsort((row, -score, at))
            at, score, row = at[order], score[order], row[order]
            fresh = np.concatenate([[True], (at[1:] != at[:-1]) | (score[1:] != score[:-1])]) if len(at) else np.zeros(0, dtype=bool)
            kept = np.arange(len(at)) - np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0)) < k
            out.append((some[at[kept]], row[kept], score[kept]))
    at, row, score = (np.concatenate(x) for x in zip(*out))
    return pa.table({"query_id": queries.column("query_id").take(pa.array(at)), "chunk_id": vectors.column("chunk_id").take(pa.array(row)), "score": pa.array(score, pa.float64())})


def dense_search(vectors: DataFrame, queries: DataFrame, k: int = 20, cells: int = 16) -> DataFrame:
    """RET3: (chunk_id, scope, v) and (query_id, scope, q) -> the k nearest by cosine within the scope.

    A scope's vectors are dealt to cells and each query goes to all of them, so that a scope with a third of
    all rows is met in many tasks; each keeps what can be among its k best before they shuffle by query. A task holds a cell and a
    block of queries. Vectors that are null, or hold nulls or values that are no numbers or very large, are joined with their queries one by one.
    """
    plain = lambda c: F.coalesce(F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e150)), F.lit(False))
    kept = vectors.select("chunk_id", "scope", F.col("v").cast("array<double>").alias("v"))
    asked = queries.select("query_id", "scope", F.col("q").cast("array<double>").alias("q"))
    good, good_q = kept.filter(plain("v")), asked.filter(plain("q"))
    n_v, n_q = good.count(), good_q.count()
    cells, blocks = max(cells, -(-n_v // CELL)), max(1, -(-n_q // ASKED))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = good.withColumn("cell", F.pmod(F.xxhash64("chunk_id"), F.lit(cells)).cast("int")).withColumn("block", every(blocks))
    met = good_q.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("cell", every(cells))
    keys = ["scope", "cell", "block"]
    run = lambda left, right: nearest(left, right, k)
    schema = f"query_id {asked.schema['query_id'].dataType.simpleString()}, chunk_id {kept.schema['chunk_id'].dataType.simpleString()}, score double"
    found = dealt.groupBy(*keys).cogroup(met.groupBy(*keys)).applyInArrow(run, schema)
    odd, odd_q = kept.filter(~plain("v")), asked.filter(~plain("q"))
    pairs = odd.join(asked, "scope").unionByName(good.join(odd_q, "scope"))
    return top(found.union(pairs.select("query_id", "chunk_id", cosine(F.col("q"), F.col("v")).alias("score"))), k)


def rrf(lists: DataFrame, k: int = RRF_K, top_n: int | None = None) -> DataFrame:
    """RET4: (query_id, place, chunk_id) rows of any number of ranked lists -> fused scores, repeats adding up."""
    fused = lists.groupBy("query_id", "chunk_id").agg(F.sum(1.0 / (k + F.col("place"))).alias("score"))
    return top(fused, top_n if top_n is not None else 2**31 - 1)


def hybrid_search(lexical: DataFrame, dense: DataFrame, seeds: DataFrame, top_n: int = 20) -> DataFrame:
    """RET6: ranked lists -> fused list with a source label; a query without fused candidates takes its dense list.

    lexical, dense and seeds have query_id, chunk_id, place. A chunk that only a seed brings is labelled
    graph_seed.
    """
    both = lexical.select("query_id", "chunk_id", "place").union(dense.select("query_id", "chunk_id", "place"))
    fused = rrf(both.union(seeds.select("query_id", "chunk_id", "place")), top_n=top_n)
    known = both.select("query_id", "chunk_id").distinct().withColumn("known", F.lit(True))
    fused = fused.join(known, ["query_id", "chunk_id"], "left").select("query_id", "chunk_id", "score", "place", F.when(F.col("known"), "rrf").otherwise("graph_seed").alias("source"))
    lone = dense.join(fused, "query_id", "left_anti").select("query_id", "chunk_id", "score", "place", F.lit("dense_rerank").alias("source"))
    return fused.unionByName(lone)


def rerank(candidates: DataFrame, k: int, scorer: Column | None = None) -> DataFrame:
    """RET7: reorder by a scorer column (or UDF); where it is null, or without one, the old order stands."""
    s = scorer if scorer is not None else F.lit(None).cast("double")
    w = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("new_score"), "place", "chunk_id")
    df = candidates.withColumn("new_score", s)
    return df.withColumn("new_place", F.row_number().over(w)).filter(F.col("new_place") <= k)


def parent_expand(hits: DataFrame, chunks: DataFrame, most: int = 3) -> DataFrame:
    """RET8: for the parents of a query's hits, in order, the first sibling not hit, `most` a query.

    hits: query_id, chunk_id, parent_id, score, place; chunks: chunk_id, parent_id, position.
    """
    hits = written(hits)
    parents = hits.filter("parent_id is not null").groupBy("query_id", "parent_id").agg(F.min("place").alias("first"), F.max("score").alias("best"))
    fresh = parents.join(chunks.select("parent_id", F.col("chunk_id").alias("sibling"), "position"), "parent_id")
    fresh = fresh.join(hits.select("query_id", F.col("chunk_id").alias("sibling")), ["query_id", "sibling"], "left_anti")
    one = fresh.groupBy("query_id", "parent_id", "first", "best").agg(F.min_by("sibling", F.struct("position", "sibling")).alias("chunk_id"))
    w = Window.partitionBy("query_id").orderBy("first", "parent_id")
    extra = one.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most)
    return extra.select("query_id", "chunk_id", "parent_id", F.greatest(F.lit(0.0), F.col("best") * SIBLING_SHARE).alias("score"), F.lit("parent_expand").alias("source"))


def attach_meta(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """RET9: chunk text and metadata beside the hits; unknown chunks keep nulls."""
    return hits.join(chunks, "chunk_id", "left")


def embed_with_cache(texts: DataFrame, cache: DataFrame, embed, model: str, kind: str = "passage") -> tuple[DataFrame, DataFrame]:
    """RET10: (text_id, text) -> vectors, cached ones by key, missing ones by embed (Arrow batches of text -> vectors).

    Equal texts are embedded once. Returns (text_id, vector, hit) and the new cache rows (key, vector).
    """
    keyed = texts.withColumn("key", embed_key(F.lit(model), F.lit(kind), "text"))
    missing = keyed.join(cache, "key", "left_anti").groupBy("key").agg(F.first("text").alias("text"))
    made = missing.mapInPandas(embed, "key string, vector array<double>")
    known = cache.select("key", "vector", F.lit(True).alias("hit")).unionByName(made.select("key", "vector", F.lit(False).alias("hit")))
    return keyed.join(known, "key").select("text_id", "vector", "hit"), made


def query_path_violations(spans: DataFrame, operations: DataFrame, barred: tuple[str, ...]) -> DataFrame:
    """RET11: operations of a barred kind that a session ran between a query's begin and end."""
    ops = operations.filter(F.col("op").isin(*barred))
    inside = (F.col("at") >= F.col("begin_at")) & (F.col("at") <= F.col("end_at"))
    return ops.join(spans, "session_id").filter(inside).select("session_id", "query_id", "op", "op_id")
