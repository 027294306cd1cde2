"""Benchmark decontamination: a broadcast set of benchmark word windows, scanned over every document.

The broadcast is bounded: benchmark items are cut into pieces (overlapping by a window less one word, so
no window is lost) and dealt into shards of at most `shard_windows` windows; every shard is one more scan
of the documents, so the bound holds for any benchmark. A shard is held as arrays, about 100 bytes a
window. Hits found by window hash are verified word by word.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, text_slices

WINDOW = 10
SHARD_WINDOWS = 500_000
#: Bytes that stay: digits, small letters, everything outside ASCII; A-Z become small, the rest parts words.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_MULT = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def hash_windows(ids: np.ndarray, n: int) -> np.ndarray:
    h = np.zeros(len(ids) - n + 1, np.uint64)
    for k in range(n):
        h = (h ^ (h >> np.uint64(29))) * _MULT + ids[k : len(ids) - n + 1 + k]
    return h


class WindowSet:
    """Windows of some benchmark items, by length: hashes in order, and beside each its word ids and its items."""

    def __init__(self, items: list[tuple], window: int):
        self.ids: dict[bytes, int] = {}
        self.names = sorted({item for item, _ in items}, key=lambda x: (x is None, str(x)))
        number = {item: i for i, item in enumerate(self.names)}
        parts: dict[int, list[tuple]] = defaultdict(list)
        for item, text in items:
            w = np.array([self.ids.setdefault(x, len(self.ids) + 1) for x in words(text)], np.uint64)
            n = min(window, len(w))
            if n:
                wins = np.lib.stride_tricks.sliding_window_view(w, n).astype(np.uint32)
                parts[n].append((hash_windows(w, n), wins, np.full(len(wins), number[item], np.int32)))
        self.lengths = {}
        for n, found in parts.items():
            h, wins, who = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(h, kind="stable")
            self.lengths[n] = (h[order], wins[order], who[order])

    def scan(self, ids: np.ndarray):
        """(first words, length, item numbers) of the occurrences; ids is 0 where a word is in no item."""
        for n, (hashes, wins, who) in self.lengths.items():
            if len(ids) < n:
                continue
            h = hash_windows(ids, n)
            lo = np.searchsorted(hashes, h)
            lo[lo == len(hashes)] = 0
            at = np.flatnonzero(hashes[lo] == h)
            lo, hi = lo[at], np.searchsorted(hashes, h[at], "right")
            while len(at):  # one more window of equal hash a turn
                same = (wins[lo] == ids[at[:, None] + np.arange(n)]).all(1)
                yield at[same], n, who[lo[same]]
                lo = lo + 1
                at, lo, hi = (x[lo < hi] for x in (at, lo, hi))


def _scan(docs: DataFrame, known: WindowSet, text_at: int, names: list[str]) -> DataFrame:
    """Adds the number of words, the word positions hit and the item ids with occurring windows to whole rows."""
    shared = docs.sparkSession.sparkContext.broadcast(known)
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema)

    def run(batches):
        windows = shared.value
        get = windows.ids.get
        for batch in batches:
            for part in text_slices(batch, batch.schema.names[text_at]):
                ids, starts = [], [0]
                for t in part.column(text_at):
                    ids.extend([get(w, 0) for w in words(t.as_py())])
                    ids.append(0)
                    starts.append(len(ids))
                flat, starts = np.array(ids, np.uint64), np.array(starts)
                covered, seen = np.zeros(len(flat), bool), set()
                for at, n, who in windows.scan(flat):
                    for k in range(n):
                        covered[at + k] = True
                    seen.update(zip((np.searchsorted(starts, at, "right") - 1).tolist(), who.tolist()))
                items = defaultdict(list)
                for d, i in sorted(seen):
                    items[d].append(None if windows.names[i] is None else str(windows.names[i]))
                hits = [(np.flatnonzero(covered[a:z])).tolist() for a, z in zip(starts[:-1], starts[1:])]
                who = [items.get(d, []) for d in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.diff(starts) - 1), pa.array(hits, pa.list_(pa.int64())), pa.array(who, pa.list_(pa.string()))], names=[*part.schema.names, *names])

    return docs.mapInArrow(run, f"{fields}`{names[0]}` long, `{names[1]}` array<long>, `{names[2]}` array<string>")


def benchmark_shards(benchmark: DataFrame, shard_windows: int = SHARD_WINDOWS, window: int = WINDOW) -> list[DataFrame]:
    """(item_id, text) as DataFrames of at most shard_windows windows each; equal pieces of an item count once."""
    most = max(1, shard_windows // 8)

    def cut(batches):
        for b in batches:
            item, text, size = [], [], []
            for i, t in enumerate(b.column(1)):
                w = words(t.as_py())
                for at in range(0, max(1, len(w) - window + 1) if w else 0, most):
                    piece = w[at : at + most + window - 1]
                    item.append(i)
                    text.append(b" ".join(piece).decode("utf-8", "surrogatepass"))
                    size.append(max(1, len(piece) - window + 1))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(item, pa.int64())), pa.array(text, pa.string()), pa.array(size, pa.int64())], names=["item_id", "text", "w"])

    kind = benchmark.schema["item_id"].dataType.simpleString()
    pieces = benchmark.select("item_id", F.col("text").cast("string")).mapInArrow(cut, f"item_id {kind}, text string, w long").distinct()
    pieces = materialize(pieces, "benchmark-pieces")
    n = int((pieces.agg(F.sum("w")).first()[0] or 0) // shard_windows) + 1
    shard = lambda n: F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    while n > 1 and pieces.groupBy(shard(n)).agg(F.sum("w").alias("w")).agg(F.max("w")).first()[0] > shard_windows:
        n = n + n // 4 + 1
    return [pieces.filter(shard(n) == i).select("item_id", "text") for i in range(n)]


def scan_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_windows: int = SHARD_WINDOWS, names: tuple[str, str, str] | None = None) -> tuple[DataFrame, list[str]]:
    """Rows of docs with the number of words, positions of hit words and ids of items (as strings), and the
    names of these three columns, which are none of docs.

    Needs a text column; every other column is carried. Null text has no words.
    """
    new = fresh(docs, "n_words", "hit", "items")
    old = fresh(docs, *new, "hit_before", "items_before")[3:]
    text_at = next(i for i, c in enumerate(docs.columns) if c.lower() == "text")
    out = docs.withColumn(docs.columns[text_at], F.col("text").cast("string"))
    for i, shard in enumerate(benchmark_shards(benchmark, shard_windows, window)):
        known = WindowSet([(r[0], r[1]) for r in shard.collect()], window)
        if not i:
            out = _scan(out, known, text_at, new)
            continue
        out = _scan(out.withColumnsRenamed(dict(zip(new[1:], old))).drop(new[0]), known, text_at, new)
        out = out.withColumns({a: F.array_union(a, b) for a, b in zip(new[1:], old)}).drop(*old)
    return out, new


def contamination(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of docs.

    An item of fewer than ten words, but not none, is one window. Null or empty texts and items have
    no words; repeated rows are judged alike; equal items each count, items of one id together. A null
    item_id is an item like any other (all such rows together) and counts in n_items, but has no name in
    items_sha256: the SHA-256 of the item ids sorted as strings and joined by commas (of the empty string
    when there are none). An empty benchmark hits nothing; empty documents give no rows.
    """
    out, (n_words, hit, items) = scan_documents(docs.select(F.col("doc_id").cast("long"), "text"), benchmark, **params)
    return out.select(
        "doc_id",
        F.col(n_words).alias("n_words"),
        F.size(hit).cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(items), ","), 256).alias("items_sha256"),
        (F.size(hit) > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """Rows of docs that hold no benchmark window, all columns as they came, whatever their names."""
    out, (_, hit, _) = scan_documents(docs, benchmark, **params)
    return out.filter(F.size(hit) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def remove_spans(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """doc_id, text with the hit words cut out (words lower-cased, one space apart) where there are hits."""
    out, (_, hit, _) = scan_documents(docs.select("doc_id", "text"), benchmark, **params)

    @F.pandas_udf("string")
    def cut(text, hit):
        def one(t, gone):
            if not len(gone):
                return t
            gone = set(gone)
            return b" ".join(w for i, w in enumerate(words(t)) if i not in gone).decode()
        return text.combine(hit, one)

    return out.select("doc_id", cut("text", hit).alias("text"))
