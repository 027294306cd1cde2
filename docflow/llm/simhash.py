"""SimHash near-duplicates linked through sharded BK-trees.

Fingerprints are made per document in Arrow batches. Only distinct fingerprints are compared: equal
ones share a class by definition. A shard is a pigeonhole bucket (fingerprints that agree on two of
five runs of bits; any two within three bits share a bucket). Each bucket's BK-tree is built and
asked in the task that owns the bucket; nothing is broadcast, so no size bound is needed. A bucket
of over `shard_rows` members is dealt into a grid of cells of at most twice that many rows, each
pair of slices meeting in one cell, so a hot bucket never lands in one task. A cell gives back a
spanning set of links, not all pairs.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import block_masks, connected_components, materialize

SHINGLE = 3
SEED = 42


def fingerprint(text: str | None) -> int:
    """Signed 64-bit SimHash of whole text; 0 for null, empty or white-space text."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    n = max(1, len(w) - SHINGLE + 1)
    shingles = map(b" ".join, zip(*(w[i:] for i in range(SHINGLE)))) if len(w) >= SHINGLE else iter([b" ".join(w)])
    hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)
    votes = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, *more: str) -> DataFrame:
    """documents -> (doc_id, fp) and the long columns `more`: one row for each row, null texts included."""
    def run(batches):
        for b in batches:
            fps = pa.array([fingerprint(t.as_py()) for t in b.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), fps, *b.columns[2:]], names=["doc_id", "fp", *more])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *more)
    return rows.mapInArrow(run, ", ".join(["doc_id long", "fp long", *(f"{c} long" for c in more)]))


class BKTree:
    """Metric tree over 64-bit words; a child hangs under the integer Hamming distance to its parent."""

    def __init__(self):
        self.words: list[int] = []
        self.children: list[dict[int, int]] = []

    def near(self, word: int, radius: int) -> list[int]:
        """Indices of all words within radius; follows only edges d with |d - distance| <= radius."""
        found, todo = [], [0] if self.words else []
        while todo:
            i = todo.pop()
            d = (self.words[i] ^ word).bit_count()
            if d <= radius:
                found.append(i)
            for edge, child in self.children[i].items():
                if d - radius <= edge <= d + radius:
                    todo.append(child)
        return found

    def add(self, word: int) -> None:
        self.words.append(word)
        self.children.append({})
        new, i = len(self.words) - 1, 0
        while i != new:
            i = self.children[i].setdefault((self.words[i] ^ word).bit_count(), new)


def spanning_links(words: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that join exactly the words that chains of steps within radius join."""
    tree, parent, links = BKTree(), [], []

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, w in enumerate(words):
        parent.append(i)
        for j in tree.near(w, radius):
            a, b = find(i), find(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((w, words[j]))
        tree.add(w)
    return links


def near_links(words: DataFrame, radius: int = 3, blocks: int = 5, shard_rows: int = 256) -> DataFrame:
    """(fp) distinct -> (u, v): spanning links of fingerprints at most radius bits apart."""
    masks = block_masks(blocks, radius)
    keys = F.array(*[F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])
    members = words.select("fp", F.explode(keys).alias("k")).select("fp", "k.c", "k.key")
    shared = members.groupBy("c", "key").agg(F.count("*").alias("n")).filter("n > 1")
    mine, other = F.pmod(F.xxhash64("fp"), F.col("slices")), F.col("other")
    cells = (
        members.join(shared, ["c", "key"])
        .withColumn("slices", F.ceil(F.col("n") / shard_rows))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
        .select("fp", "c", "key", F.least(mine, other).alias("p"), F.greatest(mine, other).alias("q"))
    )
    cells = cells.repartition("c", "key", "p", "q").sortWithinPartitions("c", "key", "p", "q", "fp")

    def run(batches):
        held: np.ndarray | None = None
        def links(rows: np.ndarray):
            cuts = np.flatnonzero((rows[1:, 1:] != rows[:-1, 1:]).any(1)) + 1
            out = [x for g in np.split(rows[:, 0], cuts) if len(g) > 1 for x in spanning_links([v & 0xFFFFFFFFFFFFFFFF for v in g.tolist()], radius)]
            uv = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(uv[:, 0]), pa.array(uv[:, 1])], names=["u", "v"])
        for b in batches:
            rows = np.column_stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)])
            rows = rows if held is None else np.concatenate([held, rows])
            if not len(rows):
                continue
            last = np.flatnonzero((rows[:, 1:] != rows[-1, 1:]).any(1))
            cut = last[-1] + 1 if len(last) else 0
            held = rows[cut:]
            if cut:
                yield links(rows[:cut])
        if held is not None and len(held):
            yield links(held)

    return cells.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, radius: int = 3, blocks: int = 5, shard_rows: int = 256) -> DataFrame:
    """documents -> doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id reachable through fingerprints at most radius bits apart, the
    document itself included. Null and empty texts have fingerprint zero and link like any other.
    Repeated rows come back as often as they came in; a null doc_id keeps its row and never becomes a
    component_id unless its whole class has no other. Other columns are ignored. Empty in, empty out.
    """
    f = materialize(fingerprints(docs), "fingerprints")
    reps = f.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    roots = connected_components(near_links(reps.select("fp"), radius, blocks, shard_rows))
    linked = roots.join(reps, F.col("node") == F.col("fp"))
    lowest = linked.groupBy("root").agg(F.min("rep").alias("low"))
    moved = linked.join(lowest, "root").select("fp", "low")
    # Written, so that the join below has a plain exchange on both sides and a hot fingerprint can be split.
    classes = materialize(reps.join(moved, "fp", "left").select("fp", F.coalesce("low", "rep").alias("component_id")), "classes")
    out = f.join(classes, "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = 3, blocks: int = 5, shard_rows: int = 256) -> DataFrame:
    """documents -> exactly one row of each near-duplicate class, all its columns.

    The row is the one of the smallest doc_id, null last, and of the smallest hash of all columns where
    rows share it. Classes are told apart by fingerprints, so null or shared doc_ids lose no class. Rows
    are found again by a hash of 128 bits over every column, which only equal rows share.
    """
    cells = [x for c in docs.columns for x in (F.col(c), F.col(c).isNull())]
    docs = docs.withColumns({"_h1": F.xxhash64(*cells), "_h2": F.xxhash64(F.lit(1), *cells)})
    f = materialize(fingerprints(docs, "_h1", "_h2"), "fingerprints")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_h1", "_h2")
    reps = materialize(f.groupBy("fp").agg(F.min(row).alias("row")), "classes")
    roots = connected_components(near_links(reps.select("fp"), radius, blocks, shard_rows))
    named = reps.join(roots, F.col("fp") == F.col("node"), "left").select(F.coalesce("root", "fp").alias("root"), "row")
    kept = named.groupBy("root").agg(F.min("row").alias("row")).select("row._h1", "row._h2").distinct()
    return docs.join(kept, ["_h1", "_h2"], "left_semi").dropDuplicates(["_h1", "_h2"]).drop("_h1", "_h2")
