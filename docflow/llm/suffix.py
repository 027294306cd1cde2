"""Long repeated substrings through a logarithmic family of sparse suffix indexes.

A full suffix array has an entry for each byte. Here the suffixes of a batch are sampled by content:
in every window of `length` bytes the k-gram with the smallest hash is an anchor, so equal strings of
`length` bytes hold the same anchor at the same offset (a winnowing guarantee, about one byte in 75).
A batch's suffix index is the ordered list of its anchors' keys. Each new batch is merge-scanned
against the levels built before (a sort-merge join of two ordered lists of distinct keys): keys met
again are candidates for long matches. Equal-sized levels then merge, so a key is rewritten a
logarithmic number of times.

Only candidates are looked at closely. Every string of `length` bytes belongs to exactly one anchor
of its document, so an anchor owns a run of string starts; the run's whole bytes are its context.
Contexts seen twice are repeats from end to end. The other contexts that share an anchor key (the
edges of passages, edited copies) are refined: a run is cut into segments of `SEGMENT` strings by their
distance from the anchor, each with its whole bytes and a core, the bytes that all its strings share.
Segments whose whole is seen twice are repeats; only segments that share a core and differ in the rest
are taken apart into single strings. Bytes are told apart by the 64-bit key of their anchor and a
64-bit hash of their own, 128 bits together; bytes themselves are not compared. A row is found again by
a 64-bit hash, and a run counts in it only if the run's bytes there have the run's own hash.
All counting is by aggregations with map-side counts, so a passage held by a third of all documents
is a handful of rows by the time it is shuffled.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import discard, materialize, text_slices

GRAM = 48
SEGMENT = 16
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours, by running minima of blocks from both ends."""
    n = len(x)
    pad = np.full(-n % w, np.iinfo(x.dtype).max, x.dtype)
    blocks = np.concatenate([x, pad]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def window_anchors(data: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """For each start of a string of `length` bytes: position of its anchor, and the anchor's key."""
    n = len(data)
    h = np.zeros(n + 1, np.uint64)
    np.cumsum(data.astype(np.uint64) * _powers(_BASE, n), out=h[1:])
    grams = (h[gram:] - h[:-gram]) * _powers(_INVERSE, n + 1 - gram)
    grams ^= grams >> np.uint64(31)
    grams *= np.uint64(0xD6E8FEB86659FD93)
    ranked = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    at = (_sliding_min(ranked, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return at, grams[at].view(np.int64)


def runs_of(texts: list[bytes], length: int, piece: int = 1 << 24):
    """(text number, key, first start, number of starts, distance of the anchor from the first start) of
    every run; runs of equal anchor, in order.

    Texts are laid end to end in pieces; strings that cross a border are left out.
    """
    out = []
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= piece):
            size += len(texts[end])
            end += 1
        group = texts[at:end]
        sizes = np.array([len(t) for t in group])
        edges = np.concatenate([[0], np.cumsum(sizes)])
        for lo in range(0, size, piece):
            data = np.frombuffer(b"".join(group), np.uint8)[lo : lo + piece + length - 1] if size else np.zeros(0, np.uint8)
            if len(data) < length:
                continue
            anchor, key = window_anchors(data, length)
            start = np.arange(lo, lo + len(anchor))
            who = np.searchsorted(edges, start, "right") - 1
            good = start + length <= edges[who + 1]
            anchor, key, start, who = anchor[good] + lo, key[good], start[good], who[good]
            if not len(start):
                continue
            first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (who[1:] != who[:-1]) | (start[1:] != start[:-1] + 1)]))
            out.append((who[first] + at, key[first], start[first] - edges[who[first]], np.diff(np.append(first, len(start))), anchor[first] - start[first]))
        at = end
    return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 5


def _bytes(text) -> bytes:
    t = text.as_py()
    return t.encode("utf-8", "surrogatepass") if t is not None else b""


def _hash(data: bytes) -> int:
    h = xxh3_64_intdigest(data)
    return h - (1 << 64) if h >= 1 << 63 else h


def _signed(hashes) -> pa.Array:
    return pa.array(np.fromiter(hashes, np.uint64).view(np.int64))


def anchors(docs: DataFrame, length: int) -> DataFrame:
    """(row, text) -> (row, start, n, reach, key, context): one row for each run of string starts."""
    def run(batches):
        for b in batches:
            for part in text_slices(b, "text"):
                texts = [_bytes(t) for t in part.column(1)]
                who, key, start, n, reach = runs_of(texts, length)
                ctx = _signed(xxh3_64_intdigest(texts[i][s : s + m - 1 + length]) for i, s, m in zip(who.tolist(), start.tolist(), n.tolist()))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(who)), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(reach.astype(np.int32)), pa.array(key), ctx], names=["row", "start", "n", "reach", "key", "context"])

    return docs.select("row", "text").mapInArrow(run, "row long, start int, n int, reach int, key long, context long")


class LogarithmicIndex:
    """Levels of ordered distinct anchor keys; level i holds 2**i batches or nothing."""

    def __init__(self):
        self.levels: list[DataFrame | None] = []
        self.written: list[DataFrame] = []

    def add(self, batch: DataFrame) -> list[DataFrame]:
        """Scan a batch of (key) rows against itself and all levels; returns lists of keys met again."""
        new = batch.groupBy("key").agg((F.count("*") > 1).alias("again")).sortWithinPartitions("key")
        new = materialize(new, "suffix-batch")
        self.written.append(new)
        met = [new.filter("again").select("key")]
        keys = new.select("key")
        met += [keys.join(level, "key", "left_semi") for level in self.levels if level is not None]
        for i, level in enumerate(self.levels):
            if level is None:
                self.levels[i] = keys
                return met
            keys = materialize(keys.union(level).distinct().sortWithinPartitions("key"), "suffix-level")
            self.written.append(keys)
            self.levels[i] = None
        self.levels.append(keys)
        return met


def _segments(pieces: DataFrame, length: int) -> DataFrame:
    """(key, context, reach, data) -> (key, context, lo, m, core, whole): strings lo .. lo + m - 1 of the piece."""
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                key, ctx, lo, m, core, whole = [], [], [], [], [], []
                for k, c, reach, data in zip(*(part.column(i).to_pylist() for i in range(4))):
                    n = len(data) - length + 1
                    for g in range((reach - n + 1) // SEGMENT, reach // SEGMENT + 1):
                        near = reach - g * SEGMENT  # the start whose anchor is nearest in this segment
                        first, last = max(0, near - SEGMENT + 1), min(n - 1, near)
                        key.append(k)
                        ctx.append(c)
                        lo.append(first)
                        m.append(last - first + 1)
                        core.append(xxh3_64_intdigest(data[near : near + length - SEGMENT + 1]))
                        whole.append(xxh3_64_intdigest(data[first : last + length], last - near & 0xFFFF))
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(ctx, pa.int64()), pa.array(lo, pa.int32()), pa.array(m, pa.int32()), _signed(core), _signed(whole)], names=["key", "context", "lo", "m", "core", "whole"])

    return pieces.select("key", "context", "reach", "data").mapInArrow(run, "key long, context long, lo int, m int, core long, whole long")


def _partly(pieces: DataFrame, length: int) -> DataFrame:
    """(key, context, reach, data) -> (key, context, spans): strings of a piece that other pieces of its key hold."""
    parts = materialize(_segments(pieces, length), "suffix-segments")
    kinds = parts.groupBy("key", "core", "whole").agg(F.count("*").alias("seen"), F.min(F.struct("context", "lo", "m")).alias("at"))
    kinds = materialize(kinds, "suffix-kinds")
    mixed = kinds.groupBy("key", "core").agg(F.count("*").alias("n"), F.min("seen").alias("least")).filter("n > 1 and least = 1").select("key", "core")
    apart = kinds.join(mixed, ["key", "core"], "left_semi").select("key", "core", "whole", "at.*")

    def strings(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                key, core, whole, off, hashes = [], [], [], [], []
                for k, c, w, lo, m, data in zip(*(part.column(i).to_pylist() for i in range(6))):
                    hashes += [xxh3_64_intdigest(data[i : i + length]) for i in range(lo, lo + m)]
                    key += [k] * m
                    core += [c] * m
                    whole += [w] * m
                    off += range(m)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (key, core, whole)] + [pa.array(off, pa.int32()), _signed(hashes)], names=["key", "core", "whole", "off", "string"])

    each = apart.join(pieces.select("key", "context", "data"), ["key", "context"]).select("key", "core", "whole", "lo", "m", "data")
    each = materialize(each.mapInArrow(strings, "key long, core long, whole long, off int, string long"), "suffix-strings")
    twice = each.groupBy("key", "string").agg(F.count("*").alias("c")).filter("c > 1").select("key", "string")
    met = each.join(twice, ["key", "string"], "left_semi").groupBy("key", "core", "whole").agg(F.collect_set("off").alias("offs"))
    state = kinds.join(met, ["key", "core", "whole"], "left").filter("seen > 1 or offs is not null").select("key", "core", "whole", (F.col("seen") > 1).alias("full"), "offs")
    state = materialize(state, "suffix-states")
    one = F.transform("offs", lambda o: F.struct((F.col("lo") + o).alias("lo"), F.lit(1).alias("m")))
    spans = F.when(F.col("full"), F.array(F.struct("lo", "m"))).otherwise(one)
    out = parts.join(state, ["key", "core", "whole"]).select("key", "context", spans.alias("s"))
    return out.groupBy("key", "context").agg(F.flatten(F.collect_list("s")).alias("spans"))


def repeated_runs(docs: DataFrame, length: int = 200, batches: int = 4) -> DataFrame:
    """(row, text) -> (row, start, n, context, spans): strings start + lo .. start + lo + m - 1 of each span also start elsewhere.

    `row` may be a hash: the caller compares the run's bytes with `context` before it trusts a span, so
    that two rows of one hash do not lend each other theirs.
    """
    found = anchors(docs, length).withColumn("batch", F.pmod(F.xxhash64("row"), F.lit(batches)).cast("int"))
    found = materialize(found, "suffix-anchors")
    index, met = LogarithmicIndex(), []
    for i in range(batches):
        met += index.add(found.filter(F.col("batch") == i).select("key"))
    shared = met[0]
    for m in met[1:]:
        shared = shared.union(m)
    # Written, so that the join below has a plain exchange on both sides and a hot key can be split.
    shared = materialize(shared.distinct(), "suffix-shared")
    posts = materialize(found.drop("batch").join(shared, "key", "left_semi"), "suffix-candidates")

    discard(found, shared, *index.written)

    contexts = posts.groupBy("key", "context").agg(F.count("*").alias("seen"), F.min(F.struct("row", "start", "n", "reach")).alias("at"))
    contexts = materialize(contexts, "suffix-contexts")
    kinds = contexts.groupBy("key").agg(F.count("*").alias("kinds"), F.min("seen").alias("least"))
    mixed = materialize(kinds.filter("kinds > 1 and least = 1").select("key"), "suffix-mixed")
    wanted = contexts.join(mixed, "key", "left_semi").select("key", "context", "at.*")
    wanted = wanted.groupBy("row").agg(F.collect_list(F.struct("key", "context", "start", "n", "reach")).alias("runs"))

    def cut(batches):
        for b in batches:
            for part in text_slices(b, "text"):
                out = []
                for text, runs in zip(part.column(0), part.column(1)):
                    data = _bytes(text)
                    own = [(r, data[r["start"] : r["start"] + r["n"] - 1 + length]) for r in runs.as_py()]
                    out += [(r["key"], r["context"], r["reach"], piece) for r, piece in own if _hash(piece) == r["context"]]
                key, ctx, reach, data = zip(*out) if out else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(ctx, pa.int64()), pa.array(reach, pa.int32()), pa.array(data, pa.binary())], names=["key", "context", "reach", "data"])

    pieces = docs.select("row", "text").join(wanted, "row").select("text", "runs").mapInArrow(cut, "key long, context long, reach int, data binary")
    pieces = materialize(pieces, "suffix-pieces")
    discard(mixed)
    # Repeated rows give a piece twice; their contexts are repeats in full, so that counting one twice changes nothing.
    partly = _partly(pieces, length)
    status = contexts.join(partly, ["key", "context"], "left").select("key", "context", (F.col("seen") > 1).alias("full"), "spans")
    status = materialize(status.filter("full or spans is not null"), "suffix-status")
    out = posts.join(status, ["key", "context"])
    all_of_it = F.array(F.struct(F.lit(0).alias("lo"), F.col("n").alias("m")))
    return out.select("row", "start", "n", "context", F.when(F.col("full"), all_of_it).otherwise(F.col("spans")).alias("spans"))


def remove_repeats(docs: DataFrame, length: int = 200, batches: int = 4, with_text: bool = True) -> DataFrame:
    """documents -> doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked, kept (bytes that stay).

    Every byte covered by a string of `length` bytes that also starts anywhere else, in the same
    document or another, goes; strings are judged on the input. A null text is empty; texts shorter
    than `length` keep all. Repeated rows are copies of one another, also under one doc_id; a null
    doc_id keeps its row. Other columns are ignored. Empty in, empty out.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = rows.withColumn("row", F.xxhash64("doc_id", "text"))
    hits = repeated_runs(rows, length, batches).groupBy("row").agg(F.collect_set(F.struct("start", "n", "context", "spans")).alias("runs"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text

    def cut(batches):
        for b in batches:
            for part in text_slices(b, "text"):
                out = []
                for text, runs in zip(part.column(1), part.column(2)):
                    data = _bytes(text)
                    own = [r for r in runs.as_py() or () if _hash(data[r["start"] : r["start"] + r["n"] - 1 + length]) == r["context"]]
                    spans = sorted((r["start"] + x["lo"], r["start"] + x["lo"] + x["m"] - 1 + length) for r in own for x in r["spans"])
                    merged: list[list[int]] = []
                    for s, e in spans:
                        if merged and s <= merged[-1][1]:
                            merged[-1][1] = max(e, merged[-1][1])
                        else:
                            merged.append([s, e])
                    edges = [0, *(x for m in merged for x in m), len(data)]
                    kept = b"".join(data[a:z] for a, z in zip(edges[::2], edges[1::2]))
                    out.append((len(data), len(data) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), kept))
                n, gone, spans_, sha, kept = zip(*out)
                columns = [part.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans_, pa.int64()), pa.array(sha)]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if with_text:
                    columns, names = [*columns, pa.array(kept, pa.binary())], [*names, "kept"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.join(hits, "row", "left").select("doc_id", "text", "runs").mapInArrow(cut, schema)
