"""Periodic runs of words: stretches that repeat with one period four times or more.

Suffix trees of a document and of its reversal (Ukkonen's construction) answer longest common
extensions in constant time: of two leaves, the depth of their lowest common ancestor is a range
minimum over the Euler tour. Every run holds a Lyndon root that is the longest Lyndon word of its
first position, under the order of the words or under the inverted one. So each position gives two
candidates, which are extended in both directions.

The trees take only the stretches of a document where a run can lie. In a run of period q a
sequence of three words comes again within q words at all but its last q + 2 positions, so what
has too few such positions in a row holds none. A stretch is never shorter than the runs in it.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices

#: Least words, and least repetitions of the period, of a run.
LEAST, TIMES = 6, 4


class Minima:
    """Range minima of an array in constant time: a table over block minima, running minima inside blocks."""

    BLOCK = 16

    def __init__(self, a: np.ndarray):
        b = self.BLOCK
        padded = np.full(-(-len(a) // b) * b, np.iinfo(np.int64).max)
        padded[: len(a)] = a
        rows = padded.reshape(-1, b)
        self.values = padded
        self.ahead = np.minimum.accumulate(rows, 1).ravel()
        self.behind = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
        self.table = [rows.min(1)]
        while (step := 1 << (len(self.table) - 1)) * 2 <= len(rows):
            last = self.table[-1]
            self.table.append(np.minimum(last[:-step], last[step:]))

    def between(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Minima of a[lo..hi], both ends included."""
        first, last = lo // self.BLOCK, hi // self.BLOCK
        out = np.minimum(self.behind[lo], self.ahead[hi])
        inner = np.flatnonzero(last - first > 1)
        level = np.frexp(last[inner] - first[inner] - 1)[1] - 1
        for k in np.unique(level):
            at = inner[level == k]
            out[at] = np.minimum(out[at], np.minimum(self.table[k][first[at] + 1], self.table[k][last[at] - (1 << k)]))
        alone = np.flatnonzero(first == last)
        x, y = lo[alone], hi[alone]
        least = self.values[x]
        for k in range(1, self.BLOCK):
            least = np.minimum(least, self.values[np.minimum(x + k, y)])
        out[alone] = least
        return out


class SuffixTree:
    """Ukkonen's suffix tree of whole numbers of which the last occurs once.

    `at` is the start of a suffix that passes the node, `depth` the node's string depth, `child`
    leads from node and next number to the node below.
    """

    def __init__(self, s: list[int]):
        n, width = len(s), max(s) + 1
        at, depth, link, child = [0], [0], [0], {}
        node = length = edge = left = 0
        for i, c in enumerate(s):
            left += 1
            waiting = 0
            while left:
                if not length:
                    edge = i
                key = node * width + s[edge]
                below = child.get(key)
                if below is None:
                    child[key] = len(at)
                    if waiting:
                        link[waiting] = node
                        waiting = 0
                else:
                    size = depth[below] - depth[node]
                    if length >= size:
                        node, length, edge = below, length - size, edge + size
                        continue
                    if s[at[below] + depth[node] + length] == c:
                        length += 1
                        if waiting:
                            link[waiting] = node
                        break
                    middle = len(at)
                    at.append(at[below])
                    depth.append(depth[node] + length)
                    link.append(0)
                    child[key] = middle
                    child[middle * width + s[at[below] + depth[middle]]] = below
                    child[middle * width + c] = len(at)
                    if waiting:
                        link[waiting] = middle
                    waiting = middle
                at.append(i - left + 1)
                depth.append(n - at[-1])
                link.append(0)
                left -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - left + 1
        self._tour(n, width, np.array(at), np.array(depth), child)

    def _tour(self, n: int, width: int, at: np.ndarray, depth: np.ndarray, child: dict) -> None:
        keys = np.fromiter(child.keys(), np.int64, len(child))
        order = np.argsort(-keys)
        kids = np.fromiter(child.values(), np.int64, len(child))[order]
        above = keys[order] // width
        parent = np.zeros(len(at), np.int64)
        parent[kids] = above
        hi = np.searchsorted(-above, -np.arange(len(at)), "right").tolist()
        lo = np.searchsorted(-above, -np.arange(len(at)), "left").tolist()
        kids, visits, stack = kids.tolist(), [], [0]
        while stack:
            v = stack.pop()
            visits.append(v)
            if lo[v] < hi[v]:
                stack += kids[lo[v] : hi[v]]
        visits = np.array(visits)
        leaf = np.flatnonzero(at[visits] + depth[visits] == n)
        #: The first visit of each suffix, and its place among the sorted suffixes.
        self.visit, self.rank = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.visit[at[visits[leaf]]] = leaf
        self.rank[at[visits[leaf]]] = np.arange(n)
        # Between two first visits the tour climbs exactly to the parents of what it enters anew.
        self.climbs = Minima(depth[parent[visits]])

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common beginning of the suffixes at i and j, i != j."""
        x, y = self.visit[i], self.visit[j]
        return self.climbs.between(np.minimum(x, y) + 1, np.maximum(x, y))


def _next_lower(rank: list[int]) -> list[int]:
    """For each position the next one of lower rank, or the length."""
    out, stack = [len(rank)] * len(rank), []
    for i, r in enumerate(rank):
        while stack and rank[stack[-1]] > r:
            out[stack.pop()] = i
        stack.append(i)
    return out


def runs_of(x: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of x, by start and period. Numbers of x are 1 or more."""
    m = len(x)
    if m < LEAST:
        return []
    tree, back = SuffixTree([*x, 0]), SuffixTree([*x[::-1], 0])
    rank = tree.rank.tolist()
    i = np.arange(m)
    i, j = np.concatenate([i, i]), np.concatenate([_next_lower(rank)[:m], _next_lower([-r for r in rank])[:m]])
    i, j = i[j < m], j[j < m]
    period = j - i
    start = i - back.common(m - i, m - j)
    length = j + tree.common(i, j) - start
    kept = length >= np.maximum(LEAST, TIMES * period)
    found = np.unique(np.stack([start[kept], period[kept], length[kept]], 1), axis=0)
    return [(a, n, p) for a, p, n in found.tolist()]


def stretches(words: list[bytes], ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches that hold every run of the documents, which lie end to end in words."""
    n = len(words)
    none = np.zeros(0, np.int64)
    if n < LEAST:
        return none, none
    h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    h = h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:] * np.uint64(0x165667B19E3779F9)
    doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    order = np.argsort(h, kind="stable")
    same = (h[order[1:]] == h[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    ahead = np.full(n, n)  # words until the three come again, in the same document
    ahead[order[:-1][same]] = (order[1:] - order[:-1])[same]
    begins, stops, reach = [], [], 1
    while (least := max(LEAST // 2, 3 * (reach // 2) + 1)) <= n:
        near = np.zeros(n + 2, bool)
        near[1:-1] = ahead <= reach
        turns = np.flatnonzero(near[1:] != near[:-1])
        x, y = turns[::2], turns[1::2]
        x, y = x[y - x >= least], y[y - x >= least]
        begins.append(x)
        stops.append(np.minimum(y + reach + 2, ends[doc[x]]) if len(x) else none)
        reach *= 2
    x, y = np.concatenate(begins), np.concatenate(stops)
    if not len(x):
        return none, none
    order = np.argsort(x, kind="stable")
    x, y = x[order], np.maximum.accumulate(y[order])
    apart = np.flatnonzero(x[1:] >= y[:-1])
    return x[np.append(0, apart + 1)], y[np.append(apart, len(x) - 1)]


def runs_of_documents(documents: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each list of words."""
    ends = np.cumsum([len(w) for w in documents])
    out: list = [[] for _ in documents]
    x, y = stretches([w for words in documents for w in words], ends)
    of = np.searchsorted(ends, x, "right")
    for d in np.unique(of):
        words, base = documents[d], int(ends[d]) - len(documents[d])
        number: dict[bytes, int] = {}
        core, places = [], []
        for lo, hi in zip((x[of == d] - base).tolist(), (y[of == d] - base).tolist()):
            # A number of its own parts the stretches, so that no run crosses from one to the next.
            core += [number.setdefault(w, len(number) + 1) for w in words[lo:hi]]
            number[b" %d" % lo] = mark = len(number) + 1
            core.append(mark)
            places += range(lo, hi + 1)
        out[d] = [(places[a], n, p) for a, n, p in runs_of(core)]
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, without those that a run holds after its first period."""
    if not runs:
        return b" ".join(words)
    steps = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    return b" ".join([w for w, inside in zip(words, np.cumsum(steps).tolist()) if not inside])


def periodic_runs(docs: DataFrame, change: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """documents -> doc_id, runs array<struct<start, length, period>> by start and period, collapsed text.

    Words are what lies between ASCII white space. A run is a stretch whose words repeat at distance
    `period` (the smallest), of LEAST words and TIMES periods at least, that no neighbouring word
    extends. collapsed keeps the first period of each run. `change` may rewrite the words of a row
    first, given its doc_id. Null and empty texts have no words: no runs, an empty text. One row
    comes out for each row in, repeated ids and null ids too. Other columns are ignored; empty in,
    empty out. A task holds the trees of one document at a time, about 1 KB for a word of its stretches.
    """
    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "text"):
                ids = part.column(0).to_pylist()
                words = [(t or b"").split() for t in part.column(1).cast(pa.binary()).to_pylist()]
                if change:
                    words = [change(i, w) for i, w in zip(ids, words)]
                found = runs_of_documents(words)
                listed = [[{"start": a, "length": n, "period": p} for a, n, p in x] for x in found]
                kept = pa.array([collapsed(w, x) for w, x in zip(words, found)], pa.binary()).cast(pa.string())
                kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(listed, kind), kept], names=["doc_id", "runs", "collapsed"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def digest(runs: DataFrame) -> DataFrame:
    """periodic_runs() -> doc_id, n_runs, the run of the greatest length / period, SHA-256 of the runs and of the text."""
    better = "aggregate(runs, cast(null as struct<start: long, length: long, period: long>), (b, r) -> if(b is null or r.length * b.period > b.length * r.period, r, b))"
    lines = "array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')"
    rows = runs.withColumn("best", F.expr(better))
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.expr(lines), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Every tenth document by the checksum of its id turns periodic from some word on; a null id never."""
    h = zlib.crc32(b"%d" % doc_id) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]
